"""Removal of byte strings that occur more than once in the corpus, by two-stage suffix sorting.

Sorting all suffixes of a corpus in one place is out of reach, so equal strings are first
brought together.  Every window of ``length`` bytes picks the smallest hash among its grams of
``gram`` bytes (winnowing); equal windows pick the same gram at the same offset, so they meet
under that gram's hash.  The consecutive windows that pick one gram form a context.  Contexts
with an equal are repeated whole; where a gram has different contexts, their bytes are sorted
by suffixes in small buffers, and the common prefixes of neighbours tell the repeated windows.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import at_most_broadcast, materialize, row_key, text_of

_PIECE = 1 << 20
_BUFFER = 1 << 18
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_RANDOM = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_SEPARATOR = 255  # no byte of UTF-8


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))))


class _Hashes:
    """Hashes of any substring of a buffer: differences of a polynomial prefix sum modulo 2^64."""

    powers = _powers(_BASE, _PIECE + 4096)
    inverse = _powers(pow(_BASE, -1, 1 << 64), _PIECE + 4096)

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_RANDOM[data] * self.powers[:len(data)])))

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[begin]) * self.inverse[begin]
        return self.mix(raw + (end - begin).astype(np.uint64) * np.uint64(_BASE))

    def grams(self, size: int) -> np.ndarray:
        return self.mix((self.sums[size:] - self.sums[:-size]) * self.inverse[:len(self.sums) - size])


def contexts_of(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, length: int, gram: int):
    """(piece, start, windows, anchor, key, context hash) of each context of the pieces that lie
    one after the other in ``data``; start and anchor count from the buffer's start."""
    if len(data) < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    hashes = _Hashes(data)
    keys = hashes.grams(gram)
    # hash above, place below: the last of equal hashes wins, whatever the buffer
    low = (keys & ~_PLACE) | (_PLACE - np.arange(len(keys), dtype=np.uint64))
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    valid = np.zeros(len(data) + 1, np.int64)
    fits = sizes >= length
    np.add.at(valid, begins[fits], 1)
    np.add.at(valid, begins[fits] + sizes[fits] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid)[:len(low)] > 0)
    if not len(starts):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    anchors = (_PLACE - (low[starts] & _PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    last = np.concatenate((first[1:], [len(starts)])) - 1
    begin, end = starts[first], starts[last] + length
    piece = np.searchsorted(begins, begin, side="right") - 1
    return piece, begin, last - first + 1, anchors[first], keys[anchors[first]], hashes.of(begin, end)


def _pieces(offsets: np.ndarray, length: int):
    """Lists of (row, begin, end) of at most about a megabyte; long rows are cut into pieces
    that overlap by ``length`` - 1 bytes, so that each window lies in one piece."""
    held, size = [], 0
    for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at = lo
        while hi - at >= length:
            end = min(hi, at + _PIECE // 2)
            held.append((row, at, end))
            size += end - at
            if size >= _PIECE // 2:
                yield held
                held, size = [], 0
            if end == hi:
                break
            at = end - length + 1
    if held:
        yield held


def _utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each value begins."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _contexts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    names = ["doc_key", "start", "windows", "anchor", "key", "ctx"]

    def each(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = _utf8(b.column(1))
            for held in _pieces(offsets, length):
                rows, lo, hi = (np.array(x, np.int64) for x in zip(*held))
                joined = np.concatenate([data[s:e] for _, s, e in held])
                begins = np.concatenate(([0], np.cumsum(hi - lo)[:-1]))
                piece, begin, windows, anchor, key, ctx = contexts_of(joined, begins, hi - lo, length, gram)
                shift = lo[piece] - offsets[rows[piece]] - begins[piece]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows[piece]], pa.int64()), pa.array((begin + shift).astype(np.int64)), pa.array(windows.astype(np.int32)),
                     pa.array((anchor - begin).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64))], names)

    return docs.mapInArrow(each, "doc_key long, start long, windows int, anchor int, key long, ctx long")


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes by their first ``depth`` bytes (order beyond is not defined).

    Two stages: the suffixes smaller than their successors are sorted directly; each other one
    follows from its successor: a scan from the smallest on puts the suffix before each one
    met at the front of its first byte's bucket.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    # -1, 0, 1: how each byte compares with the next; equal ones go by the next unequal pair
    turn = np.sign(np.diff(data.astype(np.int16), append=-1))
    after = np.where(turn != 0, np.arange(n), n - 1)
    after = np.minimum.accumulate(after[::-1])[::-1]
    smaller = turn[after] > 0
    padded = np.concatenate((data, np.zeros(depth, np.uint8)))
    direct = np.flatnonzero(smaller)
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[direct])
    direct = direct[np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")]
    ends = np.cumsum(np.bincount(data, minlength=256))
    heads = (ends - np.bincount(data, minlength=256)).tolist()
    # the directly sorted suffixes fill the ends of their buckets
    order = np.full(n, -1, np.int64)
    first = data[direct]
    sizes = np.bincount(first, minlength=256)
    order[np.arange(len(direct)) + np.repeat(ends - np.cumsum(sizes), sizes)] = direct
    out, text, induced = order.tolist(), data.tolist(), (~smaller).tolist()
    out_head = heads[text[n - 1]]
    out[out_head] = n - 1  # the last suffix follows from the empty one
    heads[text[n - 1]] += 1
    for at in out:
        if at > 0 and induced[at - 1]:
            c = text[at - 1]
            out[heads[c]] = at - 1
            heads[c] += 1
    return np.array(out, np.int64)


def common_prefixes(data: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, up to ``depth`` bytes, of each of the sorted places with the one before."""
    out = np.zeros(len(places), np.int64)
    padded = np.concatenate((data, np.zeros(depth, np.uint8)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    for lo in range(1, len(places), 4096):
        hi = min(len(places), lo + 4096)
        apart = windows[places[lo - 1:hi - 1]] != windows[places[lo:hi]]
        out[lo:hi] = np.where(apart.any(1), apart.argmax(1), depth)
    return out


def repeated_starts(texts: list[bytes], groups: list[int], length: int) -> list[np.ndarray]:
    """For each text the starts of its windows of ``length`` bytes that also start elsewhere in
    a text of its group.  (Windows equal across groups don't occur: their grams differ.)"""
    data = np.frombuffer(b"".join(t + bytes([_SEPARATOR]) for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    order = suffix_array(data, length)
    whole = np.zeros(len(data) + 1, np.int64)
    fits = sizes >= length
    np.add.at(whole, begins[fits], 1)
    np.add.at(whole, begins[fits] + sizes[fits] - length + 1, -1)
    order = order[np.cumsum(whole)[order] > 0]
    same = common_prefixes(data, order, length) >= length
    again = same.copy()
    again[:-1] |= same[1:]
    places = np.sort(order[again])
    owner = np.searchsorted(begins, places, side="right") - 1
    return [places[owner == i] - begins[i] for i in range(len(texts))]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """[from, to) of the bytes covered by windows at the sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(starts) - 1]))
    return list(zip(starts[first].tolist(), (starts[last] + length).tolist()))


def _sub_contexts(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes of the contexts asked for, each cut in two: windows that reach at least half
    the rest to the right of the gram, keyed by gram and those bytes, and the others, keyed by
    gram and the bytes to its left.  Equal windows fall in the same part and share its key,
    which tells more than the gram alone."""
    half = (length - gram) // 2
    places = F.collect_list(F.struct("start", "windows", "anchor")).alias("places")
    listed = at_most_broadcast(materialize(wanted.groupBy("doc_key").agg(places), "wanted"), 200_000)
    joined = docs.join(listed, "doc_key").select("doc_key", "text", F.to_json("places").alias("places"))

    def each(batches):
        import json
        for b in batches:
            out = []
            for d, t, p in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data = t.as_py().encode("utf-8")
                for x in json.loads(p.as_py()):
                    begin, last, at = x["start"], x["start"] + x["windows"] - 1, x["start"] + x["anchor"]
                    # windows from at - half on hold the half to the right of the gram
                    turn = max(begin, at - (length - gram - half))
                    for lo, hi, sure in ((turn, last, data[at:at + gram + half]), (begin, min(last, turn - 1), data[max(0, at - half):at + gram])):
                        if lo <= hi:
                            side = b"r" if lo == turn else b"l"
                            key = int.from_bytes(hashlib.blake2b(sure, digest_size=8, person=side).digest(), "little", signed=True)
                            out.append((key, d, lo, data[lo:hi + length]))
                if len(out) >= 4096:
                    yield rows(out)
                    out = []
            yield rows(out)

    def rows(out):
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                           pa.array(cols[3], pa.binary())], ["key", "doc_key", "start", "data"])

    return joined.mapInArrow(each, "key long, doc_key long, start long, data binary")


def _sorted_repeats(parts: DataFrame, length: int) -> DataFrame:
    """(doc_key, lo, hi): the repeated runs within groups of one key, by suffix sorting.  Groups
    come sorted, several to a buffer."""
    def each(batches):
        held: list[tuple] = []
        size = 0

        def flush(rows):
            found = repeated_starts([r[3] for r in rows], [r[0] for r in rows], length)
            out = [(r[1], r[2] + lo, r[2] + hi) for r, s in zip(rows, found) for lo, hi in _runs(s, length)]
            cols = list(zip(*out)) if out else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_key", "lo", "hi"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= _BUFFER and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(held)

    return (parts.repartition("key").sortWithinPartitions("key", "doc_key", "start")
            .mapInArrow(each, "doc_key long, lo long, hi long"))


def _hashed_repeats(parts: DataFrame, length: int) -> DataFrame:
    """The same for keys with too many parts for one buffer: their windows are counted by a
    128-bit hash of their bytes, in any number of tasks."""
    def each(batches):
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for _, d, start, data in zip(*(c.to_pylist() for c in b.columns)):
                for i in range(len(data) - length + 1):
                    h = hashlib.blake2b(data[i:i + length], digest_size=16).digest()
                    for c, v in zip(cols, (int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), d, start + i)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["h1", "h2", "doc_key", "lo"])

    windows = parts.mapInArrow(each, "h1 long, h2 long, doc_key long, lo long")
    again = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return windows.join(again, ["h1", "h2"], "left_semi").select("doc_key", "lo", (F.col("lo") + length).alias("hi"))


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 80, most_parts: int = 4000) -> DataFrame:
    """(doc_key, lo, hi): byte runs covered by strings of ``length`` bytes that also start
    elsewhere; runs may touch or overlap.  ``docs`` has doc_key and text."""
    near = Window.partitionBy("key")
    same = Window.partitionBy("key", "ctx")
    found = (_contexts(docs, length, gram).repartition("key")
             .withColumn("nth", F.row_number().over(same.orderBy("doc_key", "start")))
             .withColumn("n", F.count(F.lit(1)).over(same))
             .withColumn("mixed", F.min("ctx").over(near) != F.max("ctx").over(near))
             .where("n > 1 or mixed").select("doc_key", "start", "windows", "anchor", "nth", "n", "mixed"))
    found = materialize(found, "contexts")
    whole = found.where("n > 1").select("doc_key", F.col("start").alias("lo"), F.expr(f"start + windows - 1 + {length}").alias("hi"))
    # one of each different context is enough: the equal ones are repeated anyway
    parts = materialize(_sub_contexts(docs, found.where("mixed and nth = 1"), length, gram), "parts")
    sizes = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes, "sizes")
    few = parts.join(sizes.where(f"n <= {most_parts}").select("key"), "key", "left_semi")
    many = parts.join(sizes.where(f"n > {most_parts}").select("key"), "key", "left_semi")
    return whole.union(_sorted_repeats(few, length)).union(_hashed_repeats(many, length))


def without_repeats(docs: DataFrame, length: int = 200, gram: int = 80, most_parts: int = 4000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes left) and kept_sha256 of
    every row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else: in
    another row or elsewhere in the same one, overlaps included; strings are judged on the
    input.  Matches never cross rows.  Null and empty texts have no bytes; texts shorter than
    ``length`` bytes keep all; a null doc_id stays null; repeated rows are rows like others, so
    they repeat each other; an empty table gives no rows; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("doc_key"), text_of().alias("text"))
    spans = materialize(repeated_spans(rows.select("doc_key", "text"), length, gram, most_parts), "runs")
    # runs of one document that start in the same stretch are merged before they are collected
    merged = (spans.groupBy("doc_key", F.expr(f"lo div {length}").alias("stretch")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    listed = merged.groupBy("doc_key").agg(F.to_json(F.sort_array(F.collect_list(F.array("lo", "hi")))).alias("runs"))
    joined = rows.join(listed, "doc_key", "left").select("doc_id", "text", "runs")

    def each(batches):
        import json
        for b in batches:
            out = []
            for d, t, r in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data, at, kept, gone, runs = t.as_py().encode("utf-8"), 0, [], 0, 0
                for lo, hi in itertools.chain(json.loads(r.as_py() or "[]"), [(len(data), len(data))]):
                    if lo > at or runs == 0 and lo < len(data):
                        kept.append(data[at:lo])
                        runs += lo < len(data)
                    gone += max(0, hi - max(at, lo))
                    at = max(at, hi)
                left = b"".join(kept)
                out.append((d, len(data), gone, runs, left, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64()] * 4 + [pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return joined.mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
