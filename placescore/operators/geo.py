"""Spatial joins without pairwise products.

E6 point-in-polygon: each polygon is covered by quadtree cells, inner ones and
boundary ones with the few edges that run through them; a point looks up one
cell a level by an equi-join and is decided inside its row.  Inside = odd number
of edges crossed by the ray to +x; points on an edge are not "within".

E7 nearest station: stations are sorted along a space-filling curve and packed
into blocks of neighbours, and blocks into groups, each with the box around its places on the
unit sphere (so no edge at the date line or the poles) and one station as representative.  This small tree (at most ``MAX_BLOCKS`` blocks and
a few, whatever the number of stations) goes to the tasks, which walk it with
batches of points: distances to representatives bound the answer from above,
distances to boxes from below, and what lies beyond the least upper bound goes.
Only the blocks that are left are joined (a block's stations are one array), and
one aggregate per point takes the nearest: three shuffles (the first deals the
points out evenly), however many stations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from placescore.functions.expr import EARTH_RADIUS_KM, haversine_km
from placescore.session import store


# ------------------------------------------------------------------ A12

def polygon_edges(polys: DataFrame, key: str, wkt: str) -> DataFrame:
    """``POLYGON((x y, ...), (hole...))``/``MULTIPOLYGON`` WKT -> edge table.

    Output ``(key, ring, seq, x1, y1, x2, y2)``; each ring is closed (last point
    joined back to the first if the text does not repeat it).  Holes and parts
    are just more rings: the crossing parity handles them.
    """
    rings = polys.select(key, F.posexplode(F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), 1)).alias("ring", "txt"))
    pts = rings.select(key, "ring", F.posexplode(F.split(F.trim("txt"), r"\s*,\s*")).alias("seq", "pt"))
    pts = pts.select(key, "ring", "seq", F.split(F.trim("pt"), r"\s+").alias("xy")).select(
        key, "ring", "seq", F.col("xy")[0].cast("double").alias("x"), F.col("xy")[1].cast("double").alias("y"))
    r = pts.groupBy(key, "ring").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("__pts"))
    # a ring is one polygon ring -- bounded by the polygon's own vertex count
    first, last = F.element_at("__pts", 1), F.element_at("__pts", -1)
    closed = (first["x"] == last["x"]) & (first["y"] == last["y"])
    r = r.select(key, "ring", F.when(closed, F.col("__pts")).otherwise(F.concat("__pts", F.array(first))).alias("__pts"))
    n = F.size("__pts") - 1
    e = r.select(key, "ring", F.posexplode(F.arrays_zip(F.slice("__pts", 1, n), F.slice("__pts", 2, n))).alias("seq", "__z"))
    return e.select(key, "ring", "seq", F.col("__z")["0"]["x"].alias("x1"), F.col("__z")["0"]["y"].alias("y1"),
                    F.col("__z")["1"]["x"].alias("x2"), F.col("__z")["1"]["y"].alias("y2"))


# ------------------------------------------------------------------ E6

#: A cell of a polygon's cover is split while more edges than this run through it.
LEAF_EDGES = 24
#: Cells with edges are at least this many levels under the cell that would hold the polygon.
FINER = 2
#: The deepest level; its cells keep all their edges, however many.
MAX_DEPTH = 30


def _left(x: float, y: float, e: np.ndarray) -> np.ndarray:
    """Which edges (rows x1, y1, x2, y2) a ray from the point to the right crosses."""
    spans = (e[:, 1] > y) != (e[:, 3] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return spans & (x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0])


def _changes(x: float, y: float, cx: float, cy: float, e: np.ndarray) -> bool:
    """If the way from (x, y) to the right, then up, to the corner (cx, cy) changes between inside and outside."""
    here, turn, corner = _left(x, y, e), _left(cx, y, e), _left(cx, cy, e)
    over = (e[:, 0] > cx) != (e[:, 2] > cx)
    right = np.where(e[:, 0] > cx, e[:, 1], e[:, 3])
    up = over & (turn ^ corner ^ (right > y) ^ (right > cy))
    return bool(np.logical_xor.reduce(here ^ turn ^ up)) if len(e) else False


def _touching(x: float, y: float, w: float, e: np.ndarray) -> np.ndarray:
    """The edges that may run through the square at (x, y) of width w; a little more than it is looked at."""
    x1, y1, x2, y2 = e.T
    more = 1e-9 * (w + abs(x) + abs(y)) + 1e-12
    near = ((np.minimum(x1, x2) <= x + w + more) & (np.maximum(x1, x2) >= x - more)
            & (np.minimum(y1, y2) <= y + w + more) & (np.maximum(y1, y2) >= y - more))
    e = e[near]
    x1, y1, x2, y2 = e.T
    side = np.stack([(x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1) for cx in (x - more, x + w + more) for cy in (y - more, y + w + more)])
    slack = 1e-12 + 1e-12 * (np.abs(x2 - x1) + np.abs(y2 - y1)) * (w + abs(x) + abs(y))
    return e[(side.min(axis=0) <= slack) & (side.max(axis=0) >= -slack)]


def _cover(half: float):
    """Quadtree cells of each polygon over the square from -half to half: inner ones, and those with edges."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                edges = np.array([[p["x1"], p["y1"], p["x2"], p["y2"]] for p in row["edges"]])
                x, y = edges[:, ::2], edges[:, 1::2]
                extent = max(x.max() - x.min(), y.max() - y.min(), half * 2.0 ** (1 - MAX_DEPTH))
                top = min(MAX_DEPTH, max(0, int(np.floor(np.log2(2 * half / extent)))))
                w = 2 * half / 2 ** top
                place = lambda v: int(np.clip(np.floor((v + half) / w), 0, 2 ** top - 1))
                todo = []
                for ix in range(place(x.min()), place(x.max()) + 1):
                    for iy in range(place(y.min()), place(y.max()) + 1):
                        inside = bool(np.logical_xor.reduce(_left((ix + 1) * w - half, (iy + 1) * w - half, edges)))
                        todo.append((top, ix, iy, inside, _touching(ix * w - half, iy * w - half, w, edges)))
                while todo:
                    depth, ix, iy, inside, e = todo.pop()
                    if not len(e) and not inside:
                        continue
                    if not len(e) or depth == MAX_DEPTH or (len(e) <= LEAF_EDGES and depth >= top + FINER):
                        out.append({"__poly": row["__poly"], "__d": depth, "__ix": ix, "__iy": iy, "__in": inside,
                                    "__e": [dict(zip(("x1", "y1", "x2", "y2"), p)) for p in e.tolist()]})
                        continue
                    w = 2 * half / 2 ** (depth + 1)
                    cx, cy = 2 * (ix + 1) * w - half, 2 * (iy + 1) * w - half
                    for kx in (2 * ix, 2 * ix + 1):
                        for ky in (2 * iy, 2 * iy + 1):
                            px, py = kx * w - half, ky * w - half
                            todo.append((depth + 1, kx, ky, inside ^ _changes(px + w, py + w, cx, cy, e), _touching(px, py, w, e)))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                batch.schema.field("__poly"), ("__d", pa.int32()), ("__ix", pa.int64()), ("__iy", pa.int64()), ("__in", pa.bool_()),
                ("__e", pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])))]))

    return cells


def points_in_polygons(points: DataFrame, pkey: str, x: str, y: str, edges: DataFrame, poly_key: str,
                       cell: float | None = None, eps: float = 1e-12) -> DataFrame:
    """All (point, polygon) pairs with the point strictly within the polygon.

    Each polygon is covered by quadtree cells: inner ones, whose points are
    accepted without looking at an edge, and boundary cells, split until few
    edges run through them.  A boundary cell knows if its upper right corner is
    inside, so a point is decided by the cell's own edges on the way to that
    corner, in its own row.  Points are dealt to cells by one join (a point looks
    up one cell a level), in which Spark may split a crowded cell: nothing is
    grouped afterwards.  Rows without a place match nothing, repeated points are
    judged each for itself; a polygon's edges are one row, as its text is.  The
    cover is built when this is called (small jobs over the polygons).  ``cell`` is
    accepted from older callers and not used: cells follow the polygons.
    """
    e = edges.select(F.col(poly_key).alias("__poly"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    reach = e.agg(F.max(F.greatest(*[F.abs(c) for c in ("x1", "y1", "x2", "y2")]))).first()[0] or 1.0
    half = 2.0 ** (math.floor(math.log2(reach)) + 1)
    whole = e.groupBy("__poly").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    kind = e.schema["__poly"].dataType.simpleString()
    cover = store(whole.mapInArrow(
        _cover(half), f"__poly {kind}, __d int, __ix long, __iy long, __in boolean, __e array<struct<x1:double,y1:double,x2:double,y2:double>>"))
    depths = sorted(r[0] for r in cover.select("__d").distinct().collect())  # at most MAX_DEPTH + 1
    pts = points.select(F.col(pkey).alias("__pk"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    pts = pts.where((F.abs("__x") < half) & (F.abs("__y") < half))
    step = F.lit(2 * half) / F.pow(F.lit(2.0), F.col("__d"))
    placed = pts.withColumn("__d", F.explode(F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>"))).withColumns(
        {"__ix": F.floor((F.col("__x") + half) / step), "__iy": F.floor((F.col("__y") + half) / step)})
    j = placed.join(cover, ["__d", "__ix", "__iy"])
    X, Y = F.col("__x"), F.col("__y")
    cx, cy = (F.col("__ix") + 1) * step - half, (F.col("__iy") + 1) * step - half

    def left(p: Column, px: Column, py: Column) -> Column:
        cross = px < F.try_divide((p["x2"] - p["x1"]) * (py - p["y1"]), p["y2"] - p["y1"]) + p["x1"]
        return F.coalesce(((p["y1"] > py) != (p["y2"] > py)) & cross, F.lit(False))

    def changes(p: Column) -> Column:
        turn = left(p, cx, Y)
        right = F.when(p["x1"] > cx, p["y1"]).otherwise(p["y2"])
        up = ((p["x1"] > cx) != (p["x2"] > cx)) & ((turn != left(p, cx, cy)) != ((right > Y) != (right > cy)))
        return (left(p, X, Y) != turn) != up

    def touches(p: Column) -> Column:
        return ((F.abs((p["x2"] - p["x1"]) * (Y - p["y1"]) - (p["y2"] - p["y1"]) * (X - p["x1"])) <= eps)
                & X.between(F.least(p["x1"], p["x2"]), F.greatest(p["x1"], p["x2"]))
                & Y.between(F.least(p["y1"], p["y2"]), F.greatest(p["y1"], p["y2"])))

    odd = F.aggregate("__e", F.lit(False), lambda t, p: t != changes(p))
    return j.where((F.col("__in") != odd) & ~F.exists("__e", touches)).select(F.col("__pk").alias(pkey), F.col("__poly").alias(poly_key))


# ------------------------------------------------------------------ E7

#: Stations of a block, blocks of a group, and blocks of the whole tree (more stations: larger blocks).
BLOCK, GROUP, MAX_BLOCKS = 32, 32, 4096
#: Steps of the space-filling curve, each of which cuts a cell into 4 x 4.
CURVE_STEPS = 15


def _curve(lat, lon):
    """Place of a point along a Z-order curve over 360 x 360 degrees from (-90, -180)."""
    n = 4 ** CURVE_STEPS
    at = lambda v: F.least(F.floor(v / 360.0 * n).cast("long"), F.lit(n - 1))
    cell = F.struct(at(lat + 90.0).alias("row"), at(F.pmod(lon + 180.0, F.lit(360.0))).alias("col"))
    base = F.lit(4).cast("long")
    # From the top bit down: four times the place so far, and the quarter that the next bits of row and column name.
    quarter = lambda c, d: F.floor(c["row"] / F.pow(F.lit(2.0), d)) % 2 * 2 + F.floor(c["col"] / F.pow(F.lit(2.0), d)) % 2
    return _let(cell, lambda c: F.aggregate(F.sequence(F.lit(2 * CURVE_STEPS - 1), F.lit(0)), F.lit(0).cast("long"),
                                            lambda place, d: (place * base + quarter(c, d)).cast("long")))


def _let(value, body):
    """``body(value)`` with the value computed once, however often, and in whatever lambda, the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _place(lat, lon):
    """x, y, z of a point on the unit sphere."""
    up, round_ = F.radians(lat), F.radians(lon)
    return [(F.cos(up) * F.cos(round_)).alias("x"), (F.cos(up) * F.sin(round_)).alias("y"), F.sin(up).alias("z")]


def _slack(most):
    """Chords are rounded: a little more than ``most`` (a hundredth of a metre at least)."""
    return most * (1 + 1e-9) + 2e-9


#: Points that walk the tree at once.
WALKED = 1024


def _walk(groups: np.ndarray, many: np.ndarray, tree: np.ndarray, ids: np.ndarray):
    """Batches of points (__lat, __lon) to a row per point and block (__block) that may hold its nearest station.

    ``groups`` and ``tree`` have rows x0, x1, y0, y1, z0, z1, x, y, z; group g has the next ``many[g]`` blocks.
    Points without a place stay, with no block.
    """
    first = np.cumsum(many) - many

    def chords(p: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        return np.sqrt(((p - boxes[..., 6:]) ** 2).sum(axis=-1))

    def box_chords(p: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """Lower bounds on the chords from points to anything in boxes of the sphere."""
        return np.sqrt((np.maximum(np.maximum(boxes[..., 0:6:2] - p, p - boxes[..., 1:6:2]), 0.0) ** 2).sum(axis=-1))

    def blocks_of(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.fmin.reduce(chords(p[:, None], groups), axis=1)
        point, group = np.nonzero(~(box_chords(p[:, None], groups) > _slack(most)[:, None]))
        size = many[group]
        starts = np.cumsum(size) - size
        block = np.arange(size.sum()) + np.repeat(first[group] - starts, size)
        point = np.repeat(point, size)
        each = np.flatnonzero(np.diff(point, prepend=-1))  # every point has a group
        most = np.fmin(most, np.fmin.reduceat(chords(p[point], tree[block]), each))
        kept = ~(box_chords(p[point], tree[block]) > _slack(most)[point])
        return point[kept], block[kept]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, WALKED) for k in range(0, len(whole), WALKED)):
                known = np.logical_and(*[batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("__lat", "__lon")])
                at = np.flatnonzero(known)
                up, around = [np.radians(batch.column(c).to_numpy(zero_copy_only=False)[at].astype(float)) for c in ("__lat", "__lon")]
                rows, blocks = np.flatnonzero(~known), pa.nulls(len(batch) - len(at), pa.int64())
                if len(at):
                    with np.errstate(invalid="ignore"):  # a place that is no number is near to every block
                        point, block = blocks_of(np.stack([np.cos(up) * np.cos(around), np.cos(up) * np.sin(around), np.sin(up)], axis=1))
                    rows, blocks = np.concatenate([rows, at[point]]), pa.concat_arrays([blocks, pa.array(ids[block])])
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, blocks], names=[*batch.schema.names, "__block"])

    return walk


def _station_blocks(st: DataFrame) -> tuple[DataFrame, Callable]:
    """(rows __block, __st; the walk over the tree of blocks and groups) of stations (__slat, __slon, __s).

    Groups and blocks have a box (x0, x1, ...) and a representative (x, y, z), which is a station.  Jobs run here:
    the stations are counted, sorted and stored, and the boxes (bounded) are collected.
    """
    st = store(st)  # what follows reads it three times
    many = st.count()
    if not many:
        raise ValueError("station table has no rows with coordinates")
    size = max(BLOCK, -(-many // MAX_BLOCKS))
    sort = st.withColumn("__z", _curve(F.col("__slat"), F.col("__slon"))).repartitionByRange("__z", "__slat", "__slon")
    sort = store(sort.withColumn("__part", F.spark_partition_id()))
    # A partition of the sort holds neighbours; it is dealt into blocks in order.
    at = F.row_number().over(Window.partitionBy("__part").orderBy("__z", "__slat", "__slon")) - 1
    sort = sort.select("*", *_place(F.col("__slat"), F.col("__slon")), F.floor(at / size).alias("__nr"))
    rows = sort.groupBy("__part", "__nr").agg(
        F.collect_list(F.struct("x", "y", "z", "__slat", "__slon", "__s")).alias("__st"),  # at most ``size``
        *[f(c).alias(f"{c}{k}") for c in "xyz" for k, f in enumerate((F.min, F.max))])
    rows = store(rows.withColumn("__block", F.col("__part").cast("long") * (MAX_BLOCKS * 2) + F.col("__nr")))
    ends = {f"{c}{k}": f for c in "xyz" for k, f in enumerate((min, max))}
    tree = [r.asDict() for r in rows.select("__part", "__nr", F.col("__block").alias("id"), *ends, *[F.col("__st")[0][c].alias(c) for c in "xyz"])
            .orderBy("__block").collect()]
    groups: dict[tuple[int, int], dict] = {}
    for b in tree:
        g = groups.setdefault((b["__part"], b["__nr"] // GROUP), {**b, "many": 0})
        g.update({e: f(g[e], b[e]) for e, f in ends.items()}, many=g["many"] + 1)
    boxes = lambda of: np.array([[r[n] for n in (*ends, *"xyz")] for r in of])
    walk = _walk(boxes(groups.values()), np.array([g["many"] for g in groups.values()]), boxes(tree), np.array([b["id"] for b in tree], np.int64))
    return rows.select("__block", "__st"), walk


def nearest_station(points: DataFrame, pkey: str, lat: str, lon: str, stations: DataFrame, skey: str,
                    slat: str, slon: str, radius: float = EARTH_RADIUS_KM, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every point row gets exactly one station (nearest by haversine; ties -> smaller id).

    Keys may be null or repeat: each row is a point of its own.  Points with
    missing coordinates get a null match (O8).  ``keep`` lists station columns to
    carry.  An empty station table raises.  Jobs run here (``_station_blocks``).
    """
    st = stations.where(F.col(slat).isNotNull() & F.col(slon).isNotNull()).select(
        F.col(skey).alias("__sid"), F.col(slat).cast("double").alias("__slat"),
        F.col(slon).cast("double").alias("__slon"), *[F.col(k).alias(f"__s_{k}") for k in keep])
    # Stations that share a place differ by id only.
    st = st.groupBy("__slat", "__slon").agg(F.min(F.struct("__sid", *[f"__s_{k}" for k in keep])).alias("__s"))
    blocks, walk = _station_blocks(st)
    pos = F.col("__lat"), F.col("__lon")
    pts = points.select(F.col(pkey).alias("__pk"), F.col(lat).cast("double").alias("__lat"), F.col(lon).cast("double").alias("__lon"))
    # A row's number is given before anything is shuffled, and rides along from there on.
    pts = pts.withColumn("__row", F.monotonically_increasing_id())
    # Points may come as one partition (a small file): the walk is dealt out.
    held = pts.repartition("__row").mapInArrow(walk, StructType([*pts.schema.fields, StructField("__block", LongType())]))
    found = held.join(blocks, "__block", "left")
    # Of a block the stations with the least angle (by its cosine, and a little more), then the exact distance of these.
    turned = lambda p: F.transform("__st", lambda s: -(p["x"] * s["x"] + p["y"] * s["y"] + p["z"] * s["z"]))
    near = _let(F.struct(*_place(*pos)), lambda p: _let(turned(p), lambda cos: _let(
        F.array_min(cos) + F.lit(1e-14), lambda most: F.filter("__st", lambda s, k: F.get(cos, k) <= most))))
    best = F.array_min(F.transform(near, lambda s: F.struct(haversine_km(*pos, s["__slat"], s["__slon"], radius).alias("d"), s["__s"].alias("s"))))
    out = found.select("__row", "__pk", best.alias("__b")).groupBy("__row").agg(F.first("__pk").alias("__pk"), F.min("__b").alias("__b"))
    return out.select(F.col("__pk").alias(pkey), F.col("__b.s.__sid").alias(skey), *[F.col(f"__b.s.__s_{k}").alias(k) for k in keep],
                      F.col("__b.d").alias("distance_km"))
