"""Filter interaction audit: what each of five filters takes out, alone and in every order.

Each document becomes a mask of the filters that it fails; documents are counted by part and
mask (32 cells a part), and a Gray-code walk over the 32 subsets of filters, one toggled at a
time, gives what survives each subset.  Every step of every order is a difference of two
of these states.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

FILTERS = "ABCDE"
_CAPITALS = bytes(range(65, 91))
_REPEATED = 1 << FILTERS.index("E")


def text_failures(text: str, min_words: int = 200, min_distinct: int = 50, max_capitals: int = 2,
                  symbols: bytes = b"#$%&*|") -> int:
    """Mask of the filters that a text fails by itself: A (bit 0) under ``min_words`` words, B
    under ``min_distinct`` percent distinct words, C over ``max_capitals`` percent capitals, D
    any of ``symbols``.  Words are maximal runs of other than space, tab to carriage return."""
    raw = text.encode("utf-8")
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return ((len(words) < min_words) | (100 * len(set(words)) < min_distinct * len(words)) << 1
            | (100 * capitals > max_capitals * len(text)) << 2 | (len(raw.translate(None, symbols)) < len(raw)) << 3)


def failures(docs: DataFrame, part: str = "source", **limits) -> DataFrame:
    """doc_id, part, fails of every row of ``docs``: the mask of the filters that it fails.

    E (bit 4) fails if a row of a smaller doc_id has the same text, wherever it stands: texts
    are told apart by their SHA-256, the smallest doc_id of each text is a partial aggregate, and
    rows find it by (text, doc_id), so that a text that a third of all rows share is no hot key.
    """
    def each(batches):
        for b in batches:
            masks, digests = [], []
            for t in b.column(2):
                t = t.as_py()
                masks.append(text_failures(t, **limits))
                digests.append(hashlib.sha256(t.encode("utf-8")).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                                             ["doc_id", "part", "fails", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    rows = materialize(rows.mapInArrow(each, "doc_id long, part string, fails int, digest binary"), "failures")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (rows.join(first, ["digest", "doc_id"], "left")
            .select("doc_id", "part", F.col("fails").bitwiseOR(F.when(again, _REPEATED).otherwise(0)).alias("fails")))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails, n, good, toxic: documents of each part by the filters that they fail, and
    how many of them are labelled good or toxic.  Repeated labels of a doc_id count once."""
    known = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    return failed.join(known, "doc_id", "left").groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def subset_states(counts: dict[int, np.ndarray], n_filters: int = len(FILTERS)) -> list[np.ndarray]:
    """What survives each subset of filters, by the subset's mask; ``counts`` has the counts of
    each cell by its mask.

    Gray code toggles one filter a step.  Each cell that fails it counts its active filters up
    or down; its documents leave the running survivors as the counter leaves 0 and come back as
    it returns to 0.
    """
    active = dict.fromkeys(counts, 0)
    surviving = sum(counts.values(), np.zeros(3, np.int64))
    states = [surviving] * (1 << n_filters)
    on = 0
    for i in range(1, 1 << n_filters):
        toggled = i & -i
        on ^= toggled
        for cell, n in counts.items():
            if cell & toggled:
                active[cell] += 1 if on & toggled else -1
                if on & toggled and active[cell] == 1:
                    surviving = surviving - n
                elif not on & toggled and active[cell] == 0:
                    surviving = surviving + n
        states[on] = surviving
    return states


def audit_part(counts: dict[int, np.ndarray]) -> list[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley
    of every step of the 120 orders, from the stored states."""
    states = subset_states(counts)
    bits = [1 << i for i in range(len(FILTERS))]
    failing = [int(sum(n[0] for cell, n in counts.items() if cell & bit)) for bit in bits]
    alone = [int(counts[bit][0]) if bit in counts else 0 for bit in bits]
    shapley, out = [0] * len(bits), []
    for order in permutations(range(len(bits))):
        on = 0
        for step, f in enumerate(order, 1):
            before, on = states[on], on | bits[f]
            after = states[on]
            removed, good, toxic = (int(x) for x in before - after)
            shapley[f] += removed
            out.append(("".join(FILTERS[i] for i in order), step, int(after[0]), removed, failing[f] - removed, alone[f], good, toxic, f))
    return [(*row[:-1], shapley[row[-1]]) for row in out]


_AUDIT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", **limits) -> DataFrame:
    """One row for each part, order of the five filters and step, zeros included.

    kept (after the step), removed (by it), redundant (fail its filter, gone before),
    unique_fails (fail its filter only), good_lost and toxic_lost (removed and labelled so) and
    shapley (removed by its filter, summed over all orders) count documents of the part.

    Null texts are empty, null parts the empty string; a row without doc_id has no labels and
    never repeats another; rows that share doc_id and text do not repeat each other; an empty
    table gives no rows; further columns are ignored.
    """
    counted = cells(failures(docs, part, **limits), labels)
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))  # 32 at most

    def each(batches):
        schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
                           + [(c.split()[0], pa.int64()) for c in _AUDIT.split(", ")[3:]])
        for b in batches:
            for name, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = audit_part({c["fails"]: np.array([c["n"], c["good"], c["toxic"]], np.int64) for c in found})
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*[(name, *r) for r in rows]), schema)], schema=schema)

    return parts.mapInArrow(each, _AUDIT)


AUDIT_SQL = r"""
with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws,
                  min(doc_id) over (partition by coalesce(text, '')) first_id from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) tox
      from labels where doc_id is not null group by doc_id),
f as (select part, (case when len(ws) < 200 then 1 else 0 end)
        + (case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end)
        + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end)
        + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
        + (case when doc_id > first_id then 16 else 0 end) m, coalesce(good, 0) good, coalesce(tox, 0) tox
      from d left join l using (doc_id)),
c as (select part, m, count(*) n, sum(good) good, sum(tox) tox from f group by part, m),
x as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(k, b)),
o as (select p.k || q.k || r.k || s.k || t.k filter_order, p.b b1, q.b b2, r.b b3, s.b b4, t.b b5
      from x p, x q, x r, x s, x t where (p.b | q.b | r.b | s.b | t.b) = 31),
s as (select filter_order, 1 step, 0 before, b1 b from o union all select filter_order, 2, b1, b2 from o
      union all select filter_order, 3, b1 | b2, b3 from o union all select filter_order, 4, b1 | b2 | b3, b4 from o
      union all select filter_order, 5, b1 | b2 | b3 | b4, b5 from o),
g as (select part, filter_order, step, b,
             sum(case when (m & (before | b)) = 0 then n else 0 end) kept,
             sum(case when (m & before) = 0 and (m & b) <> 0 then n else 0 end) removed,
             sum(case when (m & before) <> 0 and (m & b) <> 0 then n else 0 end) redundant,
             sum(case when m = b then n else 0 end) unique_fails,
             sum(case when (m & before) = 0 and (m & b) <> 0 then good else 0 end) good_lost,
             sum(case when (m & before) = 0 and (m & b) <> 0 then tox else 0 end) toxic_lost
      from s, c group by part, filter_order, step, b)
select part, filter_order, cast(step as integer) step, cast(kept as bigint) kept, cast(removed as bigint) removed,
       cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost,
       cast(toxic_lost as bigint) toxic_lost, cast(sum(removed) over (partition by part, b) as bigint) shapley from g
"""
