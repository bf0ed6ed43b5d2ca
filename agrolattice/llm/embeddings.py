"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one
representative of each group."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_most_broadcast, bounded_sample, materialize
from .components import components

_ROUNDING = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by their largest component first, so
    that squares neither overflow nor vanish."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(rows: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit ``rows``: each round assigns rows by cosine and turns the centroids
    to their members' sums; an empty cell moves to the row that its centroid serves worst."""
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        nearest, cosine = _nearest(rows, centres)
        order = np.argsort(nearest, kind="stable")
        held, begin = np.unique(nearest[order], return_index=True)
        sums = np.zeros_like(centres)
        sums[held] = np.add.reduceat(rows[order], begin, axis=0)
        empty = np.setdiff1d(np.arange(len(centres)), held)
        sums[empty] = rows[np.argsort(cosine, kind="stable")[:len(empty)]]
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    best, cosine = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for lo in range(0, len(rows), chunk):
        found = rows[lo:lo + chunk] @ centres.T
        best[lo:lo + chunk] = found.argmax(axis=1)
        cosine[lo:lo + chunk] = found.max(axis=1)
    return best, cosine


def cells_of(rows: np.ndarray, centres: np.ndarray, least: float, reach: float, visits: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Home cell, whether the row is in its core, and the cells it visits, of unit rows.

    Two rows of a cell's core lie within half the angle of ``least`` of one centroid, so they
    are linked without being compared.  A partner at the angle of ``least`` lies across the
    border to another cell only if it moved the row's distance to that border; a random direction
    moves it by sin(angle) / sqrt(dimensions) in the mean square.  Rows within ``reach`` times that
    visit the cell, the ``visits`` nearest such cells at most.
    """
    cosine = rows @ centres.T
    number = np.arange(len(rows))
    home = cosine.argmax(axis=1)
    own = cosine[number, home]
    core = own >= math.sqrt((1 + least) / 2) + _ROUNDING
    margin = reach * math.sqrt(max(0.0, 1 - least * least) / rows.shape[1])
    near = np.argsort(-cosine, axis=1, kind="stable")[:, :visits + 1]
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 1e-12))
    within = (own[:, None] - cosine[number[:, None], near]) / apart[home[:, None], near] <= margin
    return home, core, [sorted(int(c) for c, ok in zip(cs, oks) if ok and c != h) for cs, oks, h in zip(near, within, home)]


def block_links(left: dict, right: dict, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weight linked to each left and each right row, and a number of its group within the block
    (-1 without links).

    ``left`` and ``right`` have ``node``, ``weight``, ``home``, ``visitor``, ``core``, ``visits`` (rows x
    slots, -1 unused) and ``unit`` rows.  A pair that also meets in the left row's home cell counts in the
    cell with the smaller number.
    """
    linked = left["unit"] @ right["unit"].T >= least
    place = {n: j for j, n in enumerate(right["node"])}
    for i, n in enumerate(left["node"]):
        if n in place:
            linked[i, place[n]] = False
    rows, cols = linked.any(axis=1), linked.any(axis=0)
    for i in np.flatnonzero(rows & left["visitor"]):
        back = (right["visits"] == left["home"][i]).any(axis=1) & (left["home"][i] < right["home"])
        linked[i] &= ~back
    of_left = linked @ right["weight"]
    # rows in no core are on both sides: those pairs count once in each direction
    both = ~left["visitor"][:, None] & ~right["core"][None, :]
    of_right = left["weight"] @ (linked & ~both)
    group_l, group_r = np.full(len(rows), -1), np.full(len(cols), -1)
    i, j = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    sub, name = linked[np.ix_(i, j)], np.arange(len(j))
    while len(j):
        through = np.where(sub, name, len(j)).min(axis=1)
        now = np.minimum(name, np.where(sub, through[:, None], len(j)).min(axis=0))
        if (now == name).all():
            group_l[i], group_r[j] = j[through], j[name]
            break
        name = now
    return of_left, of_right, group_l, group_r


_MEMBER = "label string, dim int, cell int, resident boolean, core boolean, home int, visits array<int>, node string, weight long, vec binary"


def vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, node, vec of every row; node (128-bit hash of label and components) and vec
    (the components' bytes) are null where the vector links with nothing."""
    kind = rows.schema[embedding].dataType.elementType.simpleString()
    dtype = np.dtype("<f4") if kind == "float" else np.dtype("<f8")

    def each(batches):
        for b in batches:
            nodes, raw = [], []
            for tag, v in zip(b.column(1).to_pylist(), b.column(2)):
                x = None
                if tag is not None and v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(dtype) + dtype.type(0)  # no negative zeros
                    if not (np.isfinite(x).all() and x.any()):
                        x = None
                raw.append(None if x is None else x.tobytes())
                nodes.append(None if x is None else hashlib.blake2b(raw[-1], digest_size=16, key=hashlib.sha256(tag.encode()).digest()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.string()), pa.array(raw, pa.binary())], ["vec_id", "label", "node", "vec"])

    plain = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
                        F.col(embedding).cast(f"array<{'float' if kind == 'float' else 'double'}>").alias("vec"))
    return plain.mapInArrow(each, "vec_id long, label string, node string, vec binary")


def _rows(raw: list[bytes], dtype: np.dtype) -> np.ndarray:
    return unit(np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1))


def members(nodes: DataFrame, centres: dict[int, np.ndarray], dtype: np.dtype, least: float, reach: float, visits: int) -> DataFrame:
    """A row for each node in its home cell, and one in each cell that it visits."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)

    def each(batches):
        for b in batches:
            cols = b.to_pydict()
            out = {c.split()[0]: [] for c in _MEMBER.split(", ")}
            dims = np.array([len(v) // dtype.itemsize for v in cols["vec"]])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _rows([cols["vec"][i] for i in at], dtype)
                home, core, seen = cells_of(x, shared.value.get(dim, np.eye(1, dim)), least, reach, visits)
                for i, h, c, others in zip(at.tolist(), home.tolist(), core.tolist(), seen):
                    for cell in (h, *others):
                        for k, v in zip(out, (cols["label"][i], dim, cell, cell == h, c, h, others, cols["node"][i], cols["weight"][i], cols["vec"][i])):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_ARROW)

    _ARROW = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()), ("resident", pa.bool_()), ("core", pa.bool_()), ("home", pa.int32()),
                        ("visits", pa.list_(pa.int32())), ("node", pa.string()), ("weight", pa.int64()), ("vec", pa.binary())])
    return nodes.select("label", "node", "weight", "vec").mapInArrow(each, _MEMBER)


def near_vectors(rows: DataFrame, least: float = 0.93, cell_rows: int = 512, max_cells: int = 4096, fit_rows: int = 20_000,
                 reach: float = 3.0, visits: int = 3, block: int = 512) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``rows`` (vec_id, embedding, label).

    Vectors link at a cosine of ``least`` or more (double precision) within one label.  Equal
    vectors of a label are one node with a weight, so copies cost nothing and no link of theirs is
    lost.  Spherical k-means, fitted on ``fit_rows`` nodes at most (the first by hash), has a cell
    for ``cell_rows`` nodes, ``max_cells`` at most (larger tables have larger cells, nothing is left
    out).  Each node lives in one cell and visits others near its borders (see ``cells_of``); it
    is compared with all residents of its label in these cells, so a pair is missed only if neither
    node visits the other's cell.  Nodes of a cell's core are linked without products.  The rest
    go in blocks of about ``block`` by ``block`` rows to a task, which returns sums and one edge a
    row, never pairs: large cells are as many tasks.

    component_id is the smallest vec_id reachable, itself included, and kept marks that row.
    Vectors that are null, empty, zero or hold null or non-finite components, and those without a
    label, link with nothing and keep their own id; vectors of unlike lengths never link.  A null
    vec_id gets its group's id, null if there is none, and is not kept.  Repeated rows are vectors of
    their own, linked with each other.  An empty table gives no rows; further columns are ignored.
    """
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    dtype = np.dtype("<f4") if kind == "float" else np.dtype("<f8")
    stored = materialize(vectors(rows), "vectors")
    nodes = materialize(stored.where("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low")), "nodes")
    n_cells = min(max_cells, -(-nodes.count() // cell_rows))
    centres = _fit(nodes, dtype, n_cells, fit_rows)
    placed = materialize(members(nodes, centres, dtype, least, reach, visits), "members")
    key = ["label", "dim", "cell"]
    sizes = placed.groupBy(*key).agg(F.ceil(F.expr("sum(int(not (resident and core)))") / block).alias("lefts"),
                                     F.ceil(F.expr("sum(int(resident))") / block).alias("rights"),
                                     F.expr("sum(if(resident and core, weight, 0))").alias("core_weight"),
                                     F.expr("min(if(resident and core, node, null))").alias("core_node"))
    sizes = at_most_broadcast(materialize(sizes, "cells"), 100_000)
    sized = placed.join(sizes, key)
    # left: all that is compared; right: the residents; each meets every block of the other side
    sized = sized.where("lefts > 0 and rights > 0").withColumn("h", F.xxhash64("node"))
    left = sized.where("not (resident and core)").select("*", F.lit(True).alias("is_left"), F.expr("pmod(h, lefts)").alias("i"), F.explode(F.expr("sequence(0L, rights - 1)")).alias("j"))
    right = sized.where("resident").select("*", F.lit(False).alias("is_left"), F.explode(F.expr("sequence(0L, lefts - 1)")).alias("i"), F.expr("pmod(h, rights)").alias("j"))
    columns = [*key, "i", "j", "is_left", "resident", "core", "home", "visits", "node", "weight", "vec"]
    met = left.select(columns).union(right.select(columns))

    def compare(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in columns[5:]}
        sides = []
        for side in (True, False):
            at = [i for i, x in enumerate(cols["is_left"]) if x == side]
            if not at:
                return _LINKS.empty_table()
            slots = np.full((len(at), visits), -1)
            for i, a in enumerate(at):
                slots[i, :len(cols["visits"][a])] = cols["visits"][a]
            pick = lambda c: np.array([cols[c][i] for i in at])
            sides.append({"node": [cols["node"][i] for i in at], "weight": pick("weight"), "home": pick("home"), "visitor": ~pick("resident"), "core": pick("core"),
                          "visits": slots, "unit": _rows([cols["vec"][i] for i in at], dtype)})
        l, r = sides
        of_l, of_r, group_l, group_r = block_links(l, r, least)
        found = [(n, int(w), r["node"][g]) for s, of, group in ((l, of_l, group_l), (r, of_r, group_r)) for n, w, g in zip(s["node"], of, group) if g >= 0]
        return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found), _LINKS.types)], schema=_LINKS) if found else _LINKS.empty_table()

    _LINKS = pa.schema([("node", pa.string()), ("links", pa.int64()), ("other", pa.string())])
    found = materialize(met.groupBy(*key, "i", "j").applyInArrow(compare, "node string, links long, other string"), "links")
    cores = materialize(placed.where("resident and core").join(sizes, key).select("node", F.expr("core_weight - weight").alias("links"), F.col("core_node").alias("other")), "cores")
    every = found.union(cores)
    counted = every.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(every.select(F.col("node").alias("a"), F.col("other").alias("b")).where("a <> b"))
    known = (nodes.select("node", "weight", "low").join(counted, "node", "left").join(roots, "node", "left")
             .select("node", "low", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    known = materialize(known, "linked")
    # only groups of several nodes; written out, so that the join can split a large one's rows
    lows = known.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    lows = at_most_broadcast(materialize(lows, "lows"), 1_000_000)
    named = known.join(lows, "root", "left").select("node", "n_links", F.coalesce("component_id", "low").alias("component_id"))
    out = stored.select("vec_id", "node").join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"),
                      F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def _fit(nodes: DataFrame, dtype: np.dtype, n_cells: int, fit_rows: int) -> dict[int, np.ndarray]:
    """Centroids by the vectors' length; lengths that the sample lacks have one cell."""
    by_dim: dict[int, list[bytes]] = {}
    sample = bounded_sample(nodes.select("node", "vec"), fit_rows, "node")
    for r in sample:
        by_dim.setdefault(len(r["vec"]) // dtype.itemsize, []).append(bytes(r["vec"]))
    return {dim: spherical_kmeans(_rows(raw, dtype), max(1, round(n_cells * len(raw) / len(sample)))) for dim, raw in by_dim.items()}


LINKS_SQL = """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select vec_id, cast((select count(*) from l where l.a = x.vec_id) as bigint) n_links,
       least(vec_id, coalesce((select min(b) from r where r.a = x.vec_id), vec_id)) component_id,
       least(vec_id, coalesce((select min(b) from r where r.a = x.vec_id), vec_id)) = vec_id kept
from embeddings x
"""
