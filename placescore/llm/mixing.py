"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources.  They are aggregated by membership
pattern (the set of their sources), which is all the solver sees: each pattern
offers its tokens once at cost 0, again at cost 1, a third time at cost 2 (a
convex cost of repetition), and each source takes tokens up to its target.  The
flow says how often each pattern's tokens are used; whole passes take every
document, the rest takes documents in the order of a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placescore.llm.common import cut, n_words

#: Patterns and sources that the solver takes; more is an error (sources are named by people).
MAX_PATTERNS = 20_000
#: Bits of the seeded hash that a first cut of a pattern's documents uses.
CUT_BITS = 12


def targets_of(sizes: dict, weights: dict, cap: float, total: float | None = None) -> dict:
    """Shares of ``total`` by weight, at most ``cap`` times a source's size; what is over goes to the others by weight."""
    total = float(sum(sizes.values())) if total is None else float(total)
    out: dict = {}
    open_ = [s for s in sizes if weights[s] > 0]
    out.update({s: 0.0 for s in sizes if weights[s] <= 0})
    while open_:
        rest = total - sum(out.values())
        weight = sum(weights[s] for s in open_)
        over = [s for s in open_ if rest * weights[s] / weight > cap * sizes[s]]
        if not over:
            out.update({s: rest * weights[s] / weight for s in open_})
            break
        out.update({s: float(cap * sizes[s]) for s in over})
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(supply: list[int], demand: list[float], member: list[list[int]], passes: int) -> list[list[float]]:
    """Tokens that pattern i gives to source j, at least total repetition cost.

    Pattern i may give ``supply[i]`` tokens at each of the unit costs 0, 1, ...,
    ``passes - 1``; source j takes up to ``demand[j]``.  Augments along shortest
    paths; with all costs small integers, each stage of equal cost is one maximum flow.
    """
    flow = [dict.fromkeys(m, 0.0) for m in member]
    used = [0.0] * len(supply)
    got = [0.0] * len(demand)
    givers: list[list[int]] = [[] for _ in demand]
    for i, m in enumerate(member):
        for j in m:
            givers[j].append(i)
    for level in range(1, passes + 1):
        # Patterns may now be used up to `level` times; paths move flow over other sources.
        eps = 1e-6
        while True:
            parent: dict = {}
            queue = [("p", i) for i in range(len(supply)) if level * supply[i] - used[i] > eps]
            parent.update(dict.fromkeys(queue))
            end = None
            while queue and end is None:
                nxt = []
                for node in queue:
                    kind, x = node
                    if kind == "p":
                        for j in member[x]:
                            if ("s", j) not in parent:
                                parent[("s", j)] = node
                                if demand[j] - got[j] > eps:
                                    end = ("s", j)
                                    break
                                nxt.append(("s", j))
                        if end:
                            break
                    else:
                        for i in givers[x]:
                            if flow[i][x] > eps and ("p", i) not in parent:
                                parent[("p", i)] = node
                                nxt.append(("p", i))
                queue = nxt
            if end is None:
                break
            path = [end]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            path.reverse()
            push = min(level * supply[path[0][1]] - used[path[0][1]], demand[end[1]] - got[end[1]],
                       *[flow[b[1]][a[1]] for a, b in zip(path, path[1:]) if a[0] == "s"], float("inf"))
            for a, b in zip(path, path[1:]):
                if a[0] == "p":
                    flow[a[1]][b[1]] += push
                else:
                    flow[b[1]][a[1]] -= push
            used[path[0][1]] += push
            got[end[1]] += push
    return [[f.get(j, 0.0) for j in range(len(demand))] for f in flow]


def mix(docs: DataFrame, weight_of=None, sources: Column | None = None, cap: int = 3, seed: int = 0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.0) -> DataFrame:
    """One row per row of ``docs``: id, size, sources, source, source_size, target, taken.

    ``sources`` is an array column of a document's sources (default: its one
    source; null is a source of its own, last in order).  ``weight_of(position)``
    gives the weight of the source at a position of the code-point order (default
    1, 2, 3, repeating).  ``taken`` is the words that the mix takes, repeats
    counted: ``size`` times a whole number up to ``cap``.  ``source`` is the
    pattern's first source, which ``source_size`` and ``target`` describe.  Rows
    are taken whole, so a source's tokens come within one document of the flow.
    Repeated rows share a hash and follow each other; an empty table gives no rows.
    """
    weight_of = weight_of or (lambda k: k % 3 + 1)
    members = F.array(F.col(source_col)) if sources is None else F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))
    # Null becomes U+10FFFF, after which no code point sorts.
    last = "\U0010ffff"
    rows = docs.select(
        F.col(id_col).alias("_id"), n_words(F.col(text_col)).alias("_size"),
        F.array_sort(F.transform(members, lambda s: F.coalesce(s.cast("string"), F.lit(last)))).alias("_pattern"),
        F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 15), 16, 10).cast("long").alias("_u"))
    rows = cut(rows)
    found = rows.groupBy("_pattern").agg(F.sum("_size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found.sort(key=lambda r: [s.encode() for s in r["_pattern"]])
    names = sorted({s for r in found for s in r["_pattern"]}, key=lambda s: s.encode())
    sizes = {s: sum(r["n"] for r in found if s in r["_pattern"]) for s in names}
    total = share * sum(r["n"] for r in found)
    targets = targets_of(sizes, {s: weight_of(k) for k, s in enumerate(names)}, cap, total)
    place = {s: k for k, s in enumerate(names)}
    flow = min_cost_flow([r["n"] for r in found], [targets[s] for s in names],
                         [[place[s] for s in r["_pattern"]] for r in found], cap)
    plan = []
    for r, f in zip(found, flow):
        uses = sum(f) / r["n"] if r["n"] else 0.0
        whole = min(cap, int(uses + 1e-9))
        part = round(sum(f) - whole * r["n"]) if whole < cap else 0
        first = r["_pattern"][0] if r["_pattern"] else None
        plan.append((r["_pattern"], whole, max(0, part), sizes.get(first, 0), targets.get(first, 0.0)))
    spark = docs.sparkSession
    plan_df = F.broadcast(spark.createDataFrame(  # at most MAX_PATTERNS rows
        plan, "_pattern array<string>, _whole int, _part long, source_size long, target double"))
    # The part of a pass: documents by seeded hash until the part is full.  Cells of the
    # hash are summed first, so that only the cell in which the part ends is ordered by rows.
    cell = F.shiftright("_u", 60 - CUT_BITS)
    planned = rows.join(plan_df, "_pattern").withColumn("_cell", cell)
    sums = planned.groupBy("_pattern", "_cell", "_part").agg(F.sum("_size").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("_pattern").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = (sums.withColumn("_before", before).filter((F.col("_before") < F.col("_part")) & (F.col("_before") + F.col("n") >= F.col("_part")))
            .select("_pattern", F.col("_cell").alias("_edge"), "_before"))
    edge = F.broadcast(edge)  # at most one cell of each pattern
    placed = planned.join(edge, "_pattern", "left")
    inside = placed.filter(F.col("_cell") == F.col("_edge"))
    run = F.sum("_size").over(W.partitionBy("_pattern").orderBy("_u", "_id", "_size").rowsBetween(W.unboundedPreceding, 0))
    # A document is in if at least half of it lies before the end of the part.
    inside = inside.withColumn("_in", F.col("_before") + run - F.floor(F.col("_size") / 2) <= F.col("_part"))
    outside = placed.filter((F.col("_cell") != F.col("_edge")) | F.col("_edge").isNull()).withColumn(
        "_in", F.coalesce(F.col("_cell") < F.col("_edge"), F.lit(False)))
    both = outside.unionByName(inside)
    name = F.element_at("_pattern", 1)
    return both.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"),
        F.transform("_pattern", lambda s: F.when(s != last, s)).alias("sources"),
        F.when(name != last, name).alias("source"), "source_size", "target",
        (F.col("_size") * (F.col("_whole") + F.col("_in").cast("int"))).cast("long").alias("taken"))
