"""Ranked lexical search over a length-stratified index.

Documents of equal normaliser m form a stratum; within one, a term's postings lie by term
frequency, and as m is fixed an impact is computed once for each frequency.  A stratum's bound
for a query sums its terms' largest impacts there; strata are visited in the order of their
bounds until no further one can reach the k-th best score.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.topk import top_n_per_group
from .common import at_most_broadcast, materialize, text_of

#: Letters and digits of ASCII (capitals made small) and all bytes beyond; the rest parts terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_DOCS, _TERMS_TOTAL = -1, -2


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TERMS).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Queries:
    """A block of items: the vocabulary of their terms, and each item's terms and how often it
    has them."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.terms, self.times = [], [], []
        for item, text in items:
            found = Counter(terms_of(text))
            self.ids.append(item)
            self.terms.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in found], np.int64))
            self.times.append(np.array(list(found.values()), np.int64))

    def weigh(self, n_docs: int, dfs: dict[int, int]) -> None:
        """Set the weights, repeats included; terms that no document holds or that weigh 0 go."""
        weight = np.array([term_weight(n_docs, dfs[t]) if t in dfs else 0 for t in range(len(self.vocabulary))], np.int64)
        self.weights = []
        for i, (t, n) in enumerate(zip(self.terms, self.times)):
            used = weight[t] > 0
            self.terms[i] = t[used]
            self.weights.append(weight[t[used]] * n[used])


def postings(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n (terms with repeats), terms, tfs of every document with a term: the numbers of
    the query block's terms in it (``shared``: a broadcast ``Queries``) and how often it has them."""
    def each(batches):
        number = shared.value.vocabulary
        for b in batches:
            rows, ns, ids, tfs, ends = [], [], [], [], [0]
            for i, t in enumerate(b.column(1)):
                words = terms_of(t.as_py())
                if words:
                    found = [(number[w], n) for w, n in Counter(words).items() if w in number]
                    rows.append(i), ns.append(len(words))
                    ids.extend(x for x, _ in found), tfs.extend(n for _, n in found)
                    ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((ids, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        each, "doc_id long, n long, terms array<int>, tfs array<long>")


def statistics(posted: DataFrame) -> dict[int, int]:
    """Documents of each term, and under negative keys the number of documents and of all terms:
    summed within each task first, so as many rows as the vocabulary reach the driver."""
    def each(batches):
        df, n, total = np.zeros(0, np.int64), 0, 0
        for b in batches:
            n += b.num_rows
            total += pc.sum(b.column(0)).as_py() or 0
            found = np.bincount(pc.list_flatten(b.column(1)).to_numpy(zero_copy_only=False), minlength=len(df))
            found[:len(df)] += df
            df = found
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), _DOCS, _TERMS_TOTAL], pa.int32()), pa.array([*df[at].tolist(), n, total], pa.int64())], ["term", "n"])

    rows = posted.select("n", "terms").mapInArrow(each, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r["term"]: r["n"] for r in rows}


class Shelf:
    """The index of some thousand documents by strata: postings by (stratum, term, descending tf)."""

    def __init__(self, ids: np.ndarray, unnamed: np.ndarray, m: np.ndarray, n_terms: np.ndarray, terms: np.ndarray, tfs: np.ndarray, vocabulary: int):
        self.ids, self.unnamed = ids, unnamed
        strata, stratum = np.unique(m, return_inverse=True)
        doc = np.repeat(np.arange(len(ids)), n_terms)
        order = np.lexsort((-tfs, terms, stratum[doc]))
        self.doc, terms, tfs = doc[order], terms[order], tfs[order]
        at = stratum[self.doc]
        # an impact for each (stratum, tf), spread over its postings
        top = int(tfs.max(initial=0)) + 1
        runs, run = np.unique(at * top + tfs, return_inverse=True)
        tf, norm = runs % top, strata[runs // top]
        self.impact = ((1_000_000_000 * tf) // (1000 * tf + 8 * norm))[run]
        key = at * vocabulary + terms
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        shape = (len(strata), vocabulary)
        self.begin, self.count, self.most = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        where = (at[begin], terms[begin])
        self.begin[where], self.count[where] = begin, np.diff(np.append(begin, len(key)))
        self.most[where] = self.impact[begin]  # the first posting has the largest tf

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: tuple) -> tuple:
        """``best`` (scores, ids, unnamed) after the documents of the shelf."""
        if not len(terms):
            return best
        bound = self.most[:, terms] @ weights
        order = np.argsort(-bound, kind="stable")
        lo, wave = 0, 1
        while lo < len(order):
            least = best[0][k - 1] if len(best[0]) >= k else 1
            # an equal score can still win by its doc_id
            strata = order[lo:lo + wave]
            strata = strata[bound[strata] >= least]
            if not len(strata):
                break
            grid = np.ix_(strata, terms)
            n, begin = self.count[grid].ravel(), self.begin[grid].ravel()
            weight = np.broadcast_to(weights, (len(strata), len(terms))).ravel()
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(begin - (ends - n), n)
            score = np.zeros(len(self.ids), np.int64)
            np.add.at(score, self.doc[at], self.impact[at] * np.repeat(weight, n))
            found = np.flatnonzero(score >= least)
            best = tuple(np.concatenate(x) for x in zip(best, (score[found], self.ids[found], self.unnamed[found])))
            keep = np.lexsort((best[1], best[2], -best[0]))[:k]
            best = tuple(x[keep] for x in best)
            lo, wave = lo + wave, 2 * wave
        return best


def _shelves(batches, most_docs: int, most_postings: int):
    """Columns of the batches, a bounded number of documents at a time."""
    held, docs, total = [], 0, 0
    for b in batches:
        lengths = np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            before = lengths[lo - 1] if lo else 0
            room = int(np.searchsorted(lengths, before + most_postings - total, "right"))
            hi = min(b.num_rows, lo + most_docs - docs, max(room, lo + (not held)))
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
                docs, total, lo = docs + hi - lo, total + int(lengths[hi - 1] - before), hi
            if lo < b.num_rows or docs >= most_docs:
                yield held
                held, docs, total = [], 0, 0
    if held:
        yield held


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 10, block_items: int = 1000, stratum_docs: int = 512,
                   shelf_docs: int = 8192, shelf_postings: int = 2_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each row of ``items`` by exact score.

    Items are a stated query set, searched in blocks of about ``block_items`` (by a hash); a
    block's terms are broadcast.  All documents are read: their number, their terms and each
    query term's documents are counted over the whole table, and each document is indexed.
    Strata of over ``stratum_docs`` documents are split by a hash, so that a text that a third of
    all rows share is spread; a task keeps the ``top`` of its shelves, and those are merged.

    Null and empty texts have no terms, and documents without terms count in no statistic; an
    item without a term of any document has no rows; of equal scores the smaller doc_id is
    first, a null one last; repeated rows of ``docs`` are documents of their own; repeated rows
    of ``items`` (item_id and text) are one item; empty tables give no rows; further columns
    are ignored.
    """
    spark = docs.sparkSession
    asked = materialize(items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct(), "items")
    n_blocks = max(1, -(-asked.count() // block_items))
    out = None
    for block in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).orderBy("item_id", "text")
        queries = Queries([(r["item_id"], r["text"]) for r in mine.collect()])
        found = _block_ranks(spark, docs, queries, top, stratum_docs, shelf_docs, shelf_postings)
        out = found if out is None else out.union(found)
    return out


def _block_ranks(spark, docs, queries, top, stratum_docs, shelf_docs, shelf_postings):
    posted = materialize(postings(docs, spark.sparkContext.broadcast(queries)), "postings")
    seen = statistics(posted)
    n_docs, total = seen.pop(_DOCS, 0), seen.pop(_TERMS_TOTAL, 0)
    queries.weigh(n_docs, seen)
    shared = spark.sparkContext.broadcast(queries)
    normaliser = F.expr(f"100 - 75 + ((75 * n * {n_docs}L) div {max(1, total)}L)")
    indexed = posted.withColumn("m", normaliser)
    sizes = materialize(indexed.groupBy("m").agg(F.ceil(F.count(F.lit(1)) / stratum_docs).alias("pieces")).where("pieces > 1"), "strata")
    indexed = (indexed.join(at_most_broadcast(sizes, 200_000), "m", "left")
               .withColumn("piece", F.expr("pmod(xxhash64(doc_id, n, terms), coalesce(pieces, 1))"))
               .repartition("m", "piece").sortWithinPartitions("m", "piece").select("doc_id", "m", "terms", "tfs"))

    def each(batches):
        q = shared.value
        none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
        best = [none] * len(q.ids)
        size = max(1, len(q.vocabulary))
        for held in _shelves(batches, shelf_docs, shelf_postings):
            column = lambda i: pa.concat_arrays([b.column(i) for b in held])
            ids, lists = column(0), column(2)
            shelf = Shelf(pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False), column(1).to_numpy(),
                          pc.list_value_length(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists).to_numpy().astype(np.int64),
                          pc.list_flatten(column(3)).to_numpy(), size)
            best = [shelf.search(t, w, top, b) for t, w, b in zip(q.terms, q.weights, best)]
        for number, (scores, ids, unnamed) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(scores), pa.int32()), pa.array([q.ids[number]] * len(scores), pa.int64()),
                                                  pa.array(ids, mask=unnamed), pa.array(scores)], ["item", "item_id", "doc_id", "score"])

    found = indexed.mapInArrow(each, "item int, item_id long, doc_id long, score long")
    # written once: the ranks of a hot item are taken from each bucket's first ones
    found = materialize(found.withColumn("tie", F.monotonically_increasing_id()), "found")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    return top_n_per_group(found, ["item"], order, top, ["tie"], buckets=8).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


RANK_SQL = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from documents),
tf as (select doc_id, term, count(*) tf from t group by doc_id, term),
n as (select doc_id, cast(sum(tf) as bigint) n from tf group by doc_id),
s as (select count(*) nn, cast(sum(n) as bigint) ll from n),
df as (select term, floor(1000 * ln((2 * (select nn from s) + 2) / (2 * count(*) + 1))) w from tf group by term),
q as (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark),
i as (select item_id, term, count(*) times from q group by item_id, term),
r as (select item_id, doc_id, cast(sum(times * cast(w as bigint) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll))))) as bigint) score
      from i join df using (term) join tf using (term) join n using (doc_id), s group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) rank, doc_id, score
from r where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""
