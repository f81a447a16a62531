import itertools
import random

from pyspark.sql import functions as F

from placescore.llm import mixing


def test_targets_share_what_is_over():
    t = mixing.targets_of({"a": 10, "b": 1000, "c": 1000}, {"a": 3, "b": 1, "c": 1}, 3)
    assert t["a"] == 30 and abs(t["b"] - 990) < 1e-9 and abs(sum(t.values()) - 2010) < 1e-9
    t = mixing.targets_of({"a": 10, "b": 20, "c": 1000}, {"a": 50, "b": 40, "c": 1}, 3)
    assert t["a"] == 30 and t["b"] == 60 and t["c"] == 940
    assert mixing.targets_of({"a": 0, "b": 5}, {"a": 1, "b": 2}, 3) == {"a": 0.0, "b": 5.0}


def cost(flow, supply):
    """Cheapest repetition cost of using each pattern sum(flow) tokens."""
    total = 0.0
    for f, s in zip(flow, supply):
        left, unit = sum(f), 0
        while left > 1e-6:
            total += min(left, s) * unit
            left -= min(left, s)
            unit += 1
            assert unit < 50
    return total


def test_flow_is_whole_and_cheapest():
    rnd = random.Random(1)
    for _ in range(60):
        n, m = rnd.randint(1, 3), rnd.randint(1, 2)
        supply = [rnd.randint(1, 4) for _ in range(n)]
        member = [sorted(rnd.sample(range(m), rnd.randint(1, m))) for _ in range(n)]
        demand = [float(rnd.randint(0, 6)) for _ in range(m)]
        flow = mixing.min_cost_flow(supply, demand, member, 3)
        assert all(sum(f) <= 3 * s + 1e-6 for f, s in zip(flow, supply))
        got = [sum(f[j] for f in flow) for j in range(m)]
        assert all(g <= d + 1e-6 for g, d in zip(got, demand))
        edges = [(i, j) for i in range(n) for j in member[i]]
        best = (-1.0, 0.0)
        for pick in itertools.product(*[range(min(3 * supply[i], int(demand[j])) + 1) for i, j in edges]):
            f = [[0.0] * m for _ in range(n)]
            for (i, j), v in zip(edges, pick):
                f[i][j] = float(v)
            if all(sum(f[i]) <= 3 * supply[i] for i in range(n)) and all(sum(x[j] for x in f) <= demand[j] for j in range(m)):
                total = sum(map(sum, f))
                best = max(best, (total, -cost(f, supply)))
        assert abs(sum(got) - best[0]) < 1e-6
        assert abs(cost(flow, supply) + best[1]) < 1e-6


def test_mix_of_one_source_each(spark):
    rows = [(k, "w " * (k % 9 + 1), ["b", "a", None, "é"][k % 4], 7) for k in range(900)]
    rows += [(1000, None, "a", 1), (1001, "", None, 1), (None, "x y", "tiny", 1), (3, rows[3][1], rows[3][2], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    names = ["a", "b", "tiny", "é", None]
    sizes = {s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in names}
    want = mixing.targets_of(sizes, {s: k % 3 + 1 for k, s in enumerate(names)}, 3)
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert all(abs(r["target"] - want[s]) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 10
        assert all(r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_overlapping_sources(spark):
    rows = [(k, "w w w w", [["a"], ["b"], ["a", "b"]][k % 3]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m array<string>")
    got = mixing.mix(df, sources=F.col("m"), weight_of=lambda k: [1, 3][k]).collect()
    # a is 300 tokens of 1200, b 900: b takes its own 400 and the shared 400, then repeats.
    assert abs(sum(r["taken"] for r in got) - 1200) <= 12
    assert all(r["taken"] % 4 == 0 for r in got)


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
