"""Toxicity by the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialize, text_of

_WORD = re.compile(r"[^\W\d_]+")
_STEPS = 200


def terms_of(text: str | None) -> Counter:
    """Lower-case words, and the leading 4 and 5 characters of longer ones (so that inflected
    and compound forms share terms)."""
    words = Counter(_WORD.findall((text or "").lower()))
    out = Counter(words)
    for w, n in words.items():
        if len(w) > 4:
            out[w[:4] + "~"] += n
        if len(w) > 5:
            out[w[:5] + "~"] += n
    return out


def distinct_terms(text: str | None) -> set[str]:
    """The keys of ``terms_of``, without the counts."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:4] + "~" for w in words if len(w) > 4} | {w[:5] + "~" for w in words if len(w) > 5}


class KnownTerms(dict):
    """What a word's terms (see ``terms_of``) are numbered in the vocabulary ``numbers``, looked up
    once a word; holds a bounded number of words.  Only words whose first four characters are in
    ``begins`` have any."""

    def __init__(self, numbers: dict[str, object], most: int = 100_000, longest: int = 40):
        super().__init__()
        self.numbers, self.most, self.longest = numbers, most, longest
        self.begins = {t.rstrip("~")[:4] for t in numbers}

    def __missing__(self, w: str) -> tuple:
        terms = [w] + [w[:4] + "~"] * (len(w) > 4) + [w[:5] + "~"] * (len(w) > 5)
        out = tuple(self.numbers[t] for t in terms if t in self.numbers)
        if len(w) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[w] = out
        return out

    def __reduce__(self):
        return KnownTerms, (self.numbers, self.most, self.longest)


class BlockMaxIndex:
    """Inverted index of unit vectors in blocks of examples, with each term's largest weight in
    each block.

    A query's bound for a block is the sum of its weights times the block maxima: no example
    of the block can score more.  Blocks are scored in order of their bounds, ``at_once`` and then
    twice as many in one step, until the bound falls to the k-th best cosine found, so the k
    nearest are exact.
    """

    def __init__(self, vectors: list[dict[int, float]], n_terms: int, block: int = 128, at_once: int = 16):
        self.block, self.n, self.n_terms, self.at_once = block, len(vectors), n_terms, at_once
        n_blocks = -(-self.n // block)
        self.bounds = np.zeros((n_terms, n_blocks), np.float32)
        postings: list[tuple[int, int, float]] = []
        for i, v in enumerate(vectors):
            for t, w in v.items():
                postings.append((i // block * n_terms + t, i, w))
                self.bounds[t, i // block] = max(self.bounds[t, i // block], w)
        # the postings by block and term: where each term's begin, which example, which weight
        postings.sort()
        t, i, w = (np.array(x) for x in zip(*postings)) if postings else (np.zeros(0, int),) * 3
        self.begin = np.searchsorted(t, np.arange(n_blocks * n_terms + 1))
        self.example, self.weight = i.astype(np.int32), w.astype(np.float32)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples and their cosines, larger first (smaller number on a tie);
        ``skip`` is the number of an example left out."""
        if not len(terms) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = weights @ self.bounds[terms]
        order = np.argsort(-bound, kind="stable")
        who, cos = np.zeros(0, np.int64), np.zeros(0)
        done, step = 0, self.at_once
        while done < len(order):
            some = order[done:done + step]
            if len(cos) >= k:
                some = some[bound[some] * (1 + 1e-6) >= cos[k - 1]]
                if not len(some):
                    break
            done, step = done + step, 2 * step
            lists = np.add.outer(some * self.n_terms, terms)  # a row a block
            lo = self.begin[lists]
            n = self.begin[lists + 1] - lo
            lo, n = lo.ravel(), n.ravel()
            ends = n.cumsum()
            if not ends[-1]:
                continue
            at = np.arange(ends[-1]) + (lo - ends + n).repeat(n)
            score = np.bincount(self.example[at], self.weight[at] * np.tile(weights, len(some)).repeat(n), self.n)
            found = np.flatnonzero(score > 0)
            near = score[found]
            if len(found) > k + 1:  # those below the k-th best go before the sort; one may be ``skip``
                least = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
                found, near = found[near >= least], near[near >= least]
            if skip >= 0:
                found, near = found[found != skip], near[found != skip]
            who, cos = np.concatenate((who, found)), np.concatenate((cos, near))
            best = np.lexsort((who, -cos))[:k]
            who, cos = who[best], cos[best]
        return who, cos


class Neighbours:
    """The index of labelled examples, with the vocabulary and its inverse document frequencies."""

    def __init__(self, ids: list[int], texts: list[str], labels: list[int], df: dict[str, int], n_docs: int,
                 k: int = 20, power: float = 1.0):
        self.k, self.power = k, power
        self.vocabulary = {t: i for i, t in enumerate(sorted(df))}
        self.known = KnownTerms(self.vocabulary)
        self.idf = np.array([np.log((1 + n_docs) / (1 + df[t])) for t in self.vocabulary])
        self.ids, self.labels = ids, np.array(labels, float)
        self.number = {d: i for i, d in enumerate(ids)}
        vectors = []
        for t in texts:
            terms, weights = self.vector(t)
            vectors.append(dict(zip(terms.tolist(), weights.tolist())))
        # examples come label by label, so blocks are mostly of one label and their maxima tell more
        self.index = BlockMaxIndex(vectors, len(self.vocabulary))

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit weights of a text, in the vocabulary."""
        found: dict[int, int] = {}
        begins, known = self.known.begins, self.known
        for w, n in Counter(_WORD.findall((text or "").lower())).items():
            if w[:4] in begins:
                for i in known[w]:
                    found[i] = found.get(i, 0) + n
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        terms, counts = np.array(sorted(found.items())).T
        weights = (1 + np.log(counts)) * self.idf[terms]
        size = np.sqrt((weights ** 2).sum())
        return (terms, weights / size) if size > 0 else (np.zeros(0, np.int64), np.zeros(0))

    def vote(self, text: str | None, doc_id: int | None = None) -> tuple[float, list[int], list[float]]:
        """Weighted share of toxic neighbours (0 without neighbours), their ids and cosines.  An
        example never votes on itself."""
        who, cos = self.index.nearest(*self.vector(text), self.k, self.number.get(doc_id, -1))
        weight = cos ** self.power
        share = float((weight * self.labels[who]).sum() / weight.sum()) if len(who) else 0.0
        return share, [self.ids[i] for i in who], [round(float(c), 6) for c in cos]


def associated_terms(examples: list[tuple[str, int]], min_examples: int, min_association: float) -> set[str]:
    """Terms of at least ``min_examples`` examples whose shares among toxic and clean examples
    lie ``min_association`` standard errors or more apart, either way: nearness in the other
    terms says nothing about the label."""
    with_term, n = (Counter(), Counter()), [0, 0]
    for text, label in examples:
        with_term[label].update(distinct_terms(text))
        n[label] += 1

    def apart(t):
        clean, toxic = with_term[0][t], with_term[1][t]
        p = (clean + toxic) / (n[0] + n[1])
        error = np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
        return abs(toxic / n[1] - clean / n[0]) >= min_association * error

    return {t for t in with_term[0].keys() | with_term[1].keys()
            if with_term[0][t] + with_term[1][t] >= min_examples and apart(t)}


def calibration(tally: list[tuple[int, int, int]]) -> list[float]:
    """Probability of label 1 for each vote step: pooled adjacent violators over all labelled
    training rows, so it never falls as the vote rises.  ``tally`` has (step, label, rows)."""
    pos, all_ = np.zeros(_STEPS + 1), np.zeros(_STEPS + 1)
    for step, label, n in tally:
        pos[step] += n * (label > 0)
        all_[step] += n
    share = (pos.sum() + 1) / (all_.sum() + 2)
    pools: list[list[float]] = []
    for p, n in zip(pos + 0.2 * share, all_ + 0.2):
        pools.append([p, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p2, n2, w2 = pools.pop()
            pools[-1] = [pools[-1][0] + p2, pools[-1][1] + n2, pools[-1][2] + w2]
    return [p / n for p, n, w in pools for _ in range(w)]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _document_frequencies(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """How many documents have each term of the vocabulary, and how many there are: counted
    over all documents, one row a term and task, then summed."""
    def each(batches):
        df, n, known = Counter(), 0, KnownTerms({t: t for t in vocabulary})
        for b in batches:
            for t in b.column(0):
                n += 1
                df.update({x for w in set(_WORD.findall(t.as_py().lower())) if w[:4] in known.begins for x in known[w]})
        df[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["term", "n"])

    counted = docs.select(text_of().alias("text")).mapInArrow(each, "term string, n long")
    rows = counted.groupBy("term").agg(F.sum("n").alias("n")).collect()  # as many as the vocabulary
    df = {r["term"]: r["n"] for r in rows}
    return df, df.pop("", 0)


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_toxic: int = 700, fit_clean: int = 1300,
                    min_examples: int = 8, min_association: float = 2.0, k: int = 20, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, vote, neighbours (ids) and cosines of every row.

    The labelled rows that are not held out are the training rows; at most ``fit_toxic`` and
    ``fit_clean`` of them (the first in a hash order of doc_id) are the examples.  The
    vocabulary is chosen from the examples (see ``associated_terms``); document frequencies cover
    all documents; the calibration covers all training rows, each judged without itself.  The
    nearest examples are exact (see ``BlockMaxIndex``); a neighbour's vote weighs its
    cosine; the score is the calibrated share of toxic votes.

    Null and empty texts, and texts without a known term, have no neighbours and vote 0; a
    null doc_id is not held out and unlabelled; repeated rows each get a row; repeated labels
    count once (the highest), null ones never; of the texts of an id the smallest is the example; without examples of both classes every score is
    the share of toxic training rows; an empty table gives no rows; further columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    known = (labels.where("doc_id is not null and toxic is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
             .where(~held_out()))
    examples = []
    for label, limit in ((1, fit_toxic), (0, fit_clean)):
        # ids first: only the chosen texts travel
        ids = [r["doc_id"] for r in bounded_sample(known.where(F.col("toxic") == label), limit, "doc_id")]
        chosen = rows.where(F.col("doc_id").isin(ids)) if ids else rows.limit(0)
        # one row an id, however often it is repeated
        texts = {r["doc_id"]: r["text"] for r in chosen.groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
        examples += [(i, texts[i], label) for i in ids if i in texts]
    schema = ("doc_id long, held_out boolean, vote double, neighbours array<long>, cosines array<double>")
    if len({e[2] for e in examples}) < 2:
        share = known.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
        return (rows.select("doc_id", held_out().alias("held_out"), F.lit(float(share)).alias("score"),
                            F.lit(int(share >= threshold)).alias("predicted"), F.lit(0.0).alias("vote"),
                            F.expr("cast(array() as array<bigint>)").alias("neighbours"),
                            F.expr("cast(array() as array<double>)").alias("cosines")))
    vocabulary = associated_terms([(text, label) for _, text, label in examples], min_examples, min_association)
    df, n_docs = _document_frequencies(rows, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(
        Neighbours([e[0] for e in examples], [e[1] for e in examples], [e[2] for e in examples], df, n_docs, k=k))

    def each(batches):
        model = shared.value
        for b in batches:
            votes, ids, cosines = [], [], []
            for d, t in zip(b.column(0), b.column(2)):
                v, near, cos = model.vote(t.as_py(), d.as_py())
                votes.append(v), ids.append(near), cosines.append(cos)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(votes, pa.float64()), pa.array(ids, pa.list_(pa.int64())),
                                              pa.array(cosines, pa.list_(pa.float64()))],
                                             ["doc_id", "held_out", "vote", "neighbours", "cosines"])

    voted = rows.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(each, schema)
    voted = materialize(voted, "votes")
    step = F.round(F.col("vote") * _STEPS).cast("int")
    tally = voted.join(known, "doc_id").groupBy(step.alias("step"), F.col("toxic").cast("int").alias("toxic")).count().collect()
    chance = calibration([(r["step"], r["toxic"], r["count"]) for r in tally])
    score = F.element_at(F.array(*[F.lit(float(c)) for c in chance]), step + 1)
    return (voted.withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
            .select("doc_id", "held_out", "score", "predicted", "vote", "neighbours", "cosines"))
