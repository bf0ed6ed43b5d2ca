"""Quality rules with an isolation forest over the rule statistics of each document."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialize, row_key, text_of

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios the forest splits on.
RATIOS = ["symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "word_length",
          "alpha_word_rate", "distinct_rate", "top_word_rate", "adjacent_rate"]
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_WORD = re.compile("[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_MARK = re.compile(r"[!?;:|#*$%&<>=/\\~^_]")
_SCORES = 1000


def repeat_words(words: list[str], window: int = 8) -> int:
    """Words covered by windows of ``window`` words that occur at least twice in the text."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    # rank windows of 1, 2, 4, ... words: a window is the pair of its halves' ranks
    size = 1
    while size < window:
        step = min(size, window - size)
        both = ids[:len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        _, ids = np.unique(both, return_inverse=True)
        size += step
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def rule_statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(base counts, ratios) of one whole text; all zero for a null or empty one."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return [0] * len(BASE), [0.0] * len(RATIOS)
    chars = sum(map(len, words))
    symbols = len(_SYMBOL.findall(text))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    dup = len(lines) - len(set(lines))
    repeated = repeat_words(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    adjacent = sum(a == b for a, b in zip(words, words[1:]))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    ratios = [symbols / n, dup / len(lines), repeated / n, upper / n, len(_MARK.findall(text)) / chars, chars / n,
              sum(map(str.isalpha, words)) / n, len(counts) / n ** 0.8, max(counts.values()) / n, adjacent / n]
    return [n, chars, symbols, dup, repeated], ratios


def statistics_of(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, the base counts and ``ratios`` (array) of every row; no shuffle."""
    def each(batches):
        for b in batches:
            found = [rule_statistics(t.as_py()) for t in b.column(2)]
            cols = [b.column(0), b.column(1)]
            cols += [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(BASE))]
            cols.append(pa.array([f[1] for f in found], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "doc_key", *BASE, "ratios"])

    schema = "doc_id long, doc_key long, " + ", ".join(f"{c} long" for c in BASE) + ", ratios array<double>"
    return docs.select(F.col("doc_id").cast("long"), row_key().alias("doc_key"), text_of().alias("text")).mapInArrow(each, schema)


class IsolationForest:
    """Random splits over subsamples of ordinary rows; a row's anomaly is
    2 ** (-mean path / mean path of ordinary rows).

    Cuts are drawn over the part of the whole range ``low`` to ``high`` (of all labelled rows)
    that is still open at the node, not only over the ordinary rows there: a side without
    ordinary rows ends the path at once.  So junk is isolated early even where it is as dense
    as ordinary text, and on statistics that never vary among ordinary rows.
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 100,
                 subsample: int = 256, depth: int = 14, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.trees = []
        for _ in range(trees):
            pick = rng.choice(len(rows), min(subsample, len(rows)), replace=False)
            feature, cut, left, right, path = [], [], [], [], []

            def grow(part, lo, hi, level):
                at = len(feature)
                for a, v in ((feature, 0), (cut, 0.0), (left, at), (right, at), (path, 0.0)):
                    a.append(v)
                spread = np.flatnonzero(lo < hi)
                if level >= depth or not len(part) or not len(spread):
                    path[at] = level + self._mean_path(len(part))
                    return at
                f = int(rng.choice(spread))
                c = float(rng.uniform(lo[f], hi[f]))
                feature[at], cut[at] = f, c
                below = part[:, f] <= c
                lo_up, hi_down = lo.copy(), hi.copy()
                lo_up[f] = hi_down[f] = c
                left[at] = grow(part[below], lo, hi_down, level + 1)
                right[at] = grow(part[~below], lo_up, hi, level + 1)
                return at

            grow(rows[pick], low, high, 0)
            self.trees.append(tuple(map(np.array, (feature, cut, left, right, path))))
        self.expected = 1.0
        self.expected = float(self.paths(rows).mean())

    @staticmethod
    def _mean_path(n: int) -> float:
        """Mean path of an unsuccessful search in a binary tree of n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def paths(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = np.where(rows[every, feature[at]] <= cut[at], left[at], right[at])
            total += path[at]
        return total / len(self.trees)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 2.0 ** (-self.paths(rows) / max(self.expected, 1e-9))


def choose_threshold(tally: list[tuple[int, int, int]], max_clean_loss: float) -> int:
    """The score step from which documents are rejected: of the steps that reject at most
    ``max_clean_loss`` of the good labelled rows, the one that rejects most bad ones net of
    good ones.  ``tally`` has (step, quality, rows); without bad rows nothing is rejected."""
    good, bad = np.zeros(_SCORES + 2), np.zeros(_SCORES + 2)
    for step, quality, n in tally:
        (good if quality else bad)[step] += n
    if not bad.sum():
        return _SCORES + 1
    above = lambda x: np.cumsum(x[::-1])[::-1]
    lost, caught = above(good) / max(good.sum(), 1), above(bad) / bad.sum()
    gain = np.where(lost <= max_clean_loss, caught - lost, -1.0)
    return int(len(gain) - 1 - np.argmax(gain[::-1]))


def quality_verdicts(docs: DataFrame, labels: DataFrame, max_repeat: int = 30, min_words: int = 20,
                     fit_rows: int = 8000, trees: int = 100, max_clean_loss: float = 0.0005) -> DataFrame:
    """doc_id, doc_key, base counts, base_failed, anomaly (0 to 1), kept for every row of ``docs``.

    Base: fewer than ``min_words`` words, or over ``max_repeat`` percent of the words in
    repeated 8-word windows.  The forest is fitted on at most ``fit_rows`` labelled rows that
    pass the base rules (the first in a hash order of doc_id, so the sample does not depend on
    the layout); its threshold comes from all labelled rows.  Without labelled bad rows the
    forest rejects nothing.

    Null and empty texts have zero counts and fail the base rules; a null doc_id stays null
    (and is unlabelled); repeated rows each get a row; an empty table gives no rows; labels
    with nulls are ignored and repeated labels count once (the lowest quality); further
    columns are ignored.
    """
    stats = statistics_of(docs)
    failed = f"n_words < {min_words} or 100 * n_repeat_words > {max_repeat} * n_words"
    stats = materialize(stats.withColumn("base_failed", F.expr(failed)), "quality")
    known = (labels.where("doc_id is not null and quality is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")))
    judged = stats.where("not base_failed").join(known, "doc_id").select("doc_id", "doc_key", "ratios", "quality")
    sample = bounded_sample(judged, fit_rows, "doc_id", "doc_key")
    ratios = np.array([r["ratios"] for r in sample]).reshape(len(sample), len(RATIOS))
    good = np.array([r["quality"] > 0 for r in sample], bool)
    if good.sum() < 2:
        return (stats.withColumn("anomaly", F.lit(0.0)).withColumn("kept", F.expr("not base_failed"))
                .drop("ratios"))
    forest = IsolationForest(ratios[good], ratios.min(0), ratios.max(0), trees)

    @F.pandas_udf("double")
    def anomaly(ratios: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.array(ratios.tolist()).reshape(len(ratios), -1)))

    step = F.floor(F.col("anomaly") * _SCORES).cast("int")
    scored = materialize(stats.withColumn("anomaly", anomaly("ratios")).drop("ratios"), "anomaly")
    tally = (scored.where("not base_failed").join(known, "doc_id")
             .groupBy(step.alias("step"), (F.col("quality") > 0).cast("int").alias("good"))
             .count().collect())  # at most 2 x 1001 rows
    cut = choose_threshold([(r["step"], r["good"], r["count"]) for r in tally], max_clean_loss)
    return scored.withColumn("kept", ~F.col("base_failed") & (step < cut))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep, with all their columns."""
    good = quality_verdicts(docs, labels, **options).where("kept").select(F.col("doc_key").alias("_good")).distinct()
    keyed = docs.withColumn("_key", row_key())
    return keyed.join(good, F.col("_key") == F.col("_good"), "left_semi").drop("_key")
