"""SimHash near-duplicate documents, linked through a byte-position inverted index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, text_of
from .components import components
from .hamming import buckets, byte_blocks, linked_pairs

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles (repeats included); 0 without words."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    shingle = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    begin, end = starts[:n].tolist(), ends[shingle - 1:].tolist()
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(begin[lo:hi], end[lo:hi])), ">u8", hi - lo)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, doc_key, fp) of every row of ``docs``, in Arrow batches, without a shuffle."""
    def each(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "doc_key", "fp"])

    return (docs.select(F.col("doc_id").cast("long"), row_key().alias("doc_key"), text_of().alias("text"))
            .mapInArrow(each, "doc_id long, doc_key long, fp long"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, together: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id.

    Rows with one fingerprint are linked whatever their texts; fingerprints link at
    ``max_bits`` or fewer differing bits.  A pair within ``max_bits`` differs in at most that
    many of the 8 positional bytes, so it shares at least 8 - max_bits of them: the guaranteed
    minimum.  The inverted index posts each distinct fingerprint under every choice of
    ``together`` bytes of the first ``max_bits + together`` positions (a pair reaching the
    minimum shares one such posting); the pair's shared positional bytes are then tallied over
    all 8 positions, pairs below the minimum go, and the rest are verified by their bits.

    component_id is the smallest doc_id reachable (itself included).  Null and empty texts
    have fingerprint 0 and link like others; a null doc_id gets its group's id, null only if
    the whole group has none; repeated rows each get a row; an empty table gives no rows;
    further columns are ignored.
    """
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    named = _groups(rows, max_bits, together)
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = named.join(lows, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def _groups(rows: DataFrame, max_bits: int, together: int) -> DataFrame:
    """fp, low (the smallest doc_id with it) and root (the same for all linked ones) of each
    distinct fingerprint."""
    nodes = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("low"))
    blocks = byte_blocks()
    tally = " + ".join(f"int((shiftrightunsigned(a.fp ^ b.fp, {s}) & 255L) = 0)" for s, _ in blocks)
    enough = f"{tally} >= {8 - max_bits}"
    met = buckets(nodes.select(F.col("fp").alias("id"), "fp", "weight"), max_bits, blocks, together, enough)
    pairs = linked_pairs(met, max_bits, blocks, together, enough)
    roots = components(pairs).withColumnRenamed("node", "fp")
    # a lone fingerprint is its own root
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3, together: int = 3) -> DataFrame:
    """One row of each group of ``near_duplicates``, with all columns of ``docs``: the one with
    the smallest doc_id, null ids last, ties broken by row content.  Rows, not ids, are kept, so
    an id that stands in several groups may stay several times; rows that agree in doc_id and
    text are one document.
    """
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_key")).alias("first")
    kept = (rows.join(_groups(rows, max_bits, together), "fp").groupBy("root").agg(first)
            .select(F.col("first.doc_key").alias("_kept")))
    keyed = docs.withColumn("_key", row_key())
    return keyed.join(kept, F.col("_key") == F.col("_kept"), "left_semi").dropDuplicates(["_key"]).drop("_key")
