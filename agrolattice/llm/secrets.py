"""Secret scans: base patterns, and a character convolutional network over wider candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialize, row_key, text_of

KINDS = ["assign", "access", "hex"]
EXTRA = "token"
# The patterns of the base spans.
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs are maximal, so the length can stand in the pattern
_HEX = re.compile(r"[0-9a-f]{16,}")
#: The generator: long runs of key characters with a digit, or very long ones without.
_WIDE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9]|[A-Za-z+/_=-]{28})[A-Za-z0-9+/_=-]{12,}")
_BEFORE, _INSIDE, _AFTER = 32, 64, 32
#: From window to window of a candidate; no run of a filter's width falls between two.
_STRIDE = 60
_STEPS = 1000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind as listed."""
    out = [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(out)


def window(text: str, start: int) -> str:
    """The characters before a candidate and its own first ones."""
    return text[max(0, start - _BEFORE):start].rjust(_BEFORE, "\0") + text[start:start + _INSIDE].ljust(_INSIDE, "\0")


def surroundings(text: str, start: int, end: int) -> str:
    """What the network sees: a whole candidate with the characters before and after it, as long
    as a number of overlapping windows."""
    more = -(-max(0, end + _AFTER - start - _INSIDE) // _STRIDE) * _STRIDE
    return window(text, start) + text[start + _INSIDE:start + _INSIDE + more].ljust(more, "\0")


def windows_of(seen: list[str]) -> tuple[list[str], np.ndarray]:
    """The windows of all candidates in order, and where each candidate's begin (and the end)."""
    size = _BEFORE + _INSIDE
    out = [x[i:i + size] for x in seen for i in range(0, len(x) - size + 1, _STRIDE)]
    return out, np.cumsum([0, *[(len(x) - size) // _STRIDE + 1 for x in seen]])


def window_chunks(seen: list[str], most: int = 4096) -> Iterator[tuple[list[str], list[int]]]:
    """The windows of all candidates in order, at most ``most`` at a time, each with the number of
    its candidate: a run of any length needs the memory of one chunk."""
    windows, owners = [], []
    for i, x in enumerate(seen):
        for at in range(0, len(x) - _BEFORE - _INSIDE + 1, _STRIDE):
            windows.append(x[at:at + _BEFORE + _INSIDE])
            owners.append(i)
            if len(windows) == most:
                yield windows, owners
                windows, owners = [], []
    if windows:
        yield windows, owners


def largest(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of each candidate the number of its window with the largest value (the first on a tie)."""
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.lexsort((np.arange(len(values)), -values, owner))
    return order[begins[:-1]]


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label): label 1 where the candidate meets a base span."""
    out, i = [], 0
    reach = sorted((s, e) for s, _, e in base)
    for m in _WIDE.finditer(text):
        while i < len(reach) and reach[i][1] <= m.start():
            i += 1
        out.append((m.start(), m.end(), int(any(s < m.end() and m.start() < e for s, e in reach[i:i + 8]))))
    return out


def _classes(windows: list[str]) -> np.ndarray:
    """Character classes of windows of equal length: ASCII as it is, one class for the rest."""
    if not windows:
        return np.zeros((0, _BEFORE + _INSIDE), np.int64)
    codes = np.frombuffer("".join(windows).encode("utf-32-le"), "<u4").reshape(len(windows), -1)
    return np.minimum(codes, 127).astype(np.int64)


class CharacterNetwork:
    """Convolution over one-hot characters, ReLU, maximum over the places, logistic output.

    A convolution of one-hot rows is a sum of gathered weight rows, which is how it is done.  A
    candidate of several windows (``begins``, see ``windows_of``) has the output of its largest.
    """

    def __init__(self, filters: int = 16, width: int = 5, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.1, (width, 128, filters)).astype(np.float32)
        self.b = np.zeros(filters, np.float32)
        # maximum over the places before the candidate and over its own, apart
        self.v = rng.normal(0, 0.3, 2 * filters).astype(np.float32)
        self.c = np.float32(0)
        self.scale, self.shift = 1.0, 0.0

    def _forward(self, x):
        width = len(self.w)
        places = x.shape[1] - width + 1
        z = np.broadcast_to(self.b, (len(x), places, len(self.b))).copy()
        for k in range(width):
            z += self.w[k][x[:, k:k + places]]
        cut = _BEFORE - width + 1
        first, last = z[:, :cut].argmax(1), z[:, cut:].argmax(1) + cut
        rows, cols = np.arange(len(x))[:, None], np.arange(len(self.b))[None]
        pooled = np.concatenate([z[rows, first, cols], z[rows, last, cols]], 1)
        return np.maximum(pooled, 0), np.concatenate([first, last], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = [self._forward(x[i:i + 256])[0] @ self.v + self.c for i in range(0, len(x), 256)]
        return np.concatenate(out).astype(float) if out else np.zeros(0)

    def best(self, x: np.ndarray, begins: np.ndarray | None) -> np.ndarray:
        """The windows that decide: each candidate's largest."""
        if begins is None or len(begins) == len(x) + 1:
            return np.arange(len(x))
        return largest(self.raw(x), begins)

    def score(self, x: np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
        """Calibrated probabilities."""
        raw = self.raw(x)
        if begins is not None:
            raw = raw[largest(raw, begins)]
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -30, 30)))

    def score_candidates(self, seen: list[str], most: int = 4096) -> np.ndarray:
        """Calibrated probabilities of candidates, a chunk of windows in memory at a time."""
        raw = np.full(len(seen), -np.inf)
        for windows, owners in window_chunks(seen, most):
            np.maximum.at(raw, owners, self.raw(_classes(windows)))
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, begins: np.ndarray | None = None, epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 3):
        """Adam on the log loss; both classes weigh the same."""
        rng = np.random.default_rng(seed)
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        params, filters, width = ["w", "b", "v", "c"], len(self.b), len(self.w)
        m = {p: np.zeros_like(getattr(self, p)) for p in params}
        s = {p: np.zeros_like(getattr(self, p)) for p in params}
        t = 0
        begins = np.arange(len(x) + 1) if begins is None else begins
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                i = order[lo:lo + batch]
                held = np.concatenate([np.arange(begins[j], begins[j + 1]) for j in i])
                xi = x[held][self.best(x[held], np.cumsum([0, *(begins[i + 1] - begins[i])]))]
                pooled, at = self._forward(xi)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.v + self.c, -30, 30)))
                d = ((p - y[i]) * weight[i] / len(i)).astype(np.float32)
                back = d[:, None] * self.v * (pooled > 0)
                grad = {"v": pooled.T @ d, "c": d.sum(), "b": back[:, :filters].sum(0) + back[:, filters:].sum(0),
                        "w": np.zeros_like(self.w)}
                col = np.tile(np.arange(filters), 2)[None].repeat(len(i), 0)
                for k in range(width):
                    np.add.at(grad["w"][k], (np.take_along_axis(xi, at + k, 1), col), back)
                t += 1
                for q in params:
                    m[q] = 0.9 * m[q] + 0.1 * grad[q]
                    s[q] = 0.999 * s[q] + 0.001 * grad[q] ** 2
                    step = rate * (m[q] / (1 - 0.9 ** t)) / (np.sqrt(s[q] / (1 - 0.999 ** t)) + 1e-8)
                    setattr(self, q, (getattr(self, q) - step).astype(np.float32))
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, begins: np.ndarray | None = None, steps: int = 200):
        """Platt scaling on rows kept out of the fit."""
        raw = self.raw(x[self.best(x, begins)])
        for _ in range(steps):
            g = 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -30, 30))) - y
            self.scale -= 0.1 * float((g * raw).mean())
            self.shift -= 0.1 * float(g.mean())
        return self


def _spans_of(docs: DataFrame) -> DataFrame:
    span = pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())])
    cand = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("label", pa.int32()), ("seen", pa.string())])

    def each(batches):
        for b in batches:
            base, cands = [], []
            for t in b.column(2):
                text = t.as_py()
                own = base_spans(text)
                base.append([{"s": s, "k": k, "e": e} for s, k, e in own])
                cands.append([{"s": s, "e": e, "label": y, "seen": surroundings(text, s, e)} for s, e, y in candidate_spans(text, own)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, pa.list_(span)),
                                              pa.array(cands, pa.list_(cand))], ["doc_id", "doc_key", "base", "cands"])

    return (docs.select(F.col("doc_id").cast("long"), row_key().alias("doc_key"), text_of().alias("text"))
            .mapInArrow(each, "doc_id long, doc_key long, base array<struct<s:int,k:int,e:int>>, "
                              "cands array<struct<s:int,e:int,label:int,seen:string>>"))


def recall_threshold(tally: list[tuple[int, int, int]], recall: float) -> int:
    """The highest score step at or above which ``recall`` of the labelled findings lie."""
    found = np.zeros(_STEPS + 2)
    for step, label, n in tally:
        found[step] += n * (label > 0)
    if not found.sum():
        return _STEPS + 1
    above = np.cumsum(found[::-1])[::-1]
    return int(np.flatnonzero(above >= recall * found.sum())[-1])


def find_secrets(docs: DataFrame, fit_rows: int = 6000, recall: float = 0.98) -> DataFrame:
    """doc_id, doc_key, base and extra (arrays of (s, k, e); code points, end exclusive; extra
    spans have k = 3) of every row of ``docs``.

    A candidate that meets a base span is a labelled finding, any other a non-finding.  The
    network learns them whole, with their surroundings, in overlapping windows, on at most ``fit_rows`` candidates (the first
    in a hash order, a quarter kept out for calibration) and scores every candidate; the
    threshold is the highest that keeps ``recall`` of all labelled findings of the corpus.
    Non-findings at or above it are extra spans.  With findings of one class only there are
    none.

    Null and empty texts have no spans; a null doc_id stays null; repeated rows each get a row;
    an empty table gives no rows; further columns are ignored.
    """
    found = materialize(_spans_of(docs), "secrets")
    cands = found.where("size(cands) > 0").select("doc_key", F.explode("cands").alias("x")).select("doc_key", "x.*")
    sample = bounded_sample(cands, fit_rows, "doc_key", "s")
    y = np.array([r["label"] for r in sample], float)
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    keep_out = np.arange(len(y)) % 4 == 3
    if len(set(y[~keep_out])) < 2:
        return found.select("doc_id", "doc_key", "base", none.alias("extra"))
    net = CharacterNetwork()
    for learn, part in ((net.fit, ~keep_out), (net.calibrate, keep_out)):
        windows, begins = windows_of([r["seen"] for r, own in zip(sample, part) if own])
        learn(_classes(windows), y[part], begins)

    def score(batches):
        for b in batches:
            lists = b.column(b.schema.get_field_index("cands"))
            flat = lists.flatten()
            p = net.score_candidates(flat.field("seen").to_pylist())
            steps = np.floor(p * _STEPS).astype(np.int32)
            scored = pa.StructArray.from_arrays([flat.field("s"), flat.field("e"), flat.field("label"), pa.array(steps)],
                                                ["s", "e", "label", "step"])
            offsets = np.concatenate(([0], np.cumsum([len(v) for v in lists]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(offsets), scored)],
                                             ["doc_id", "doc_key", "base", "cands"])

    scored = materialize(found.mapInArrow(score, "doc_id long, doc_key long, base array<struct<s:int,k:int,e:int>>, "
                                                 "cands array<struct<s:int,e:int,label:int,step:int>>"), "scored")
    tally = (scored.where("size(cands) > 0").select(F.explode("cands").alias("x"))
             .groupBy("x.step", "x.label").count().collect())  # at most 2 x 1001 rows
    cut = recall_threshold([(r["step"], r["label"], r["count"]) for r in tally], recall)
    extra = F.expr(f"transform(filter(cands, x -> x.label = 0 and x.step >= {cut}), x -> struct(x.s as s, {len(KINDS)} as k, x.e as e))")
    return scored.select("doc_id", "doc_key", "base", extra.alias("extra"))


def spans_text(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in [*KINDS, EXTRA])
    return F.expr(f"array_join(transform(array_sort({spans}), x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')")


def count_of(kind: str) -> Column:
    return F.expr(f"cast(size(filter(base, x -> x.k = {KINDS.index(kind)})) as bigint)")
