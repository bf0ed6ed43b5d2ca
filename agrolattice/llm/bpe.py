"""Byte-pair encoding by backtracking over longest token matches, and decoding.

The greedy longest match of an Aho-Corasick automaton is kept as long as each neighbouring
pair of tokens is compatible, that is, as long as the merges would leave the two tokens side
by side; where it is not, the last token is shortened or taken back.  Positions once left are
never entered again, so the walk is linear.  The result is exactly that of the merges.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

# The white space of Unicode, and the published pre-token pattern.
_WS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WS + r"\p{L}\p{N}]+|["
             + _WS + r"]+(?![^" + _WS + r"])|[" + _WS + r"]+")
# Runs that pre-tokens never cross: a blank before a visible character opens one.
_RUN = re.compile(" ?[^" + _WS + "]+|[" + _WS + "]+(?![^" + _WS + "])|[" + _WS + "]+")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 characters stand
    for themselves, the other bytes for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + i)] = b
    return out


class _Bounded(dict):
    """A memo that is emptied when full and keeps no text of over 64 characters: memory stays
    bounded, results do not change."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        out = self.make(key)
        if not isinstance(key, str) or len(key) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[key] = out
        return out


class Codec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str, memo: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level vocabularies without normaliser or prefix space are supported")
        alphabet = _byte_alphabet()
        raw = lambda s: "".join(chr(alphabet[c]) for c in s)  # noqa: E731  latin-1 text holds bytes
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in added}
        self.rank, self.parts, self.joined = {}, {}, {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            self.joined[left, right] = token
            if token not in self.rank:
                self.rank[token], self.parts[token] = rank, (left, right)
        self.compatible = _Bounded(self._compatible, 4 * memo)
        self.length = {i: len(t) for t, i in vocab.items()}
        # tokens that merging their own bytes yields; others can't occur
        self.text = {i: t for t, i in vocab.items() if len(t) == 1 or i in self.parts}
        self.automaton = ahocorasick.Automaton()
        for i, t in self.text.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.by_text = by_text = {t: i for i, t in self.text.items()}
        self.shorter = _Bounded(lambda i: next((by_text[self.text[i][:n]] for n in range(len(self.text[i]) - 1, 0, -1)
                                                if self.text[i][:n] in by_text), None), len(vocab) + 1)
        self.added = added
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pretoken = regex.compile(_PRETOKEN)
        self.words, self.pieces = _Bounded(self._run, memo), _Bounded(self._piece, memo)
        # decoding: all tokens' bytes in one array, and where each begins
        pieces = {v: k.encode("latin-1") for k, v in vocab.items()} | {v: k.encode() for k, v in added.items()}
        n = max(pieces) + 1
        sizes = np.fromiter((len(pieces.get(i, b"")) for i in range(n)), np.int64, n)
        self.offset = np.concatenate(([0], np.cumsum(sizes)))
        self.bytes = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(n)), np.uint8)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Do the merges leave these two tokens side by side?  Both are taken apart again,
        the later merge first; a merge across the border that comes before the merge undone
        last would have joined them."""
        left, right = pair
        rank, parts, joined = self.rank, self.parts, self.joined
        limit = len(rank) + 1
        while True:
            both = joined.get((left, right))
            if both is not None and rank[both] < limit:
                return False
            undo_left, undo_right = rank.get(left, -1), rank.get(right, -1)
            if undo_left < 0 and undo_right < 0:
                return True
            if undo_left > undo_right:
                # at equal ranks the left one was merged first
                limit, left = undo_left, parts[left][1]
            else:
                limit, right = undo_right + 1, parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token given as latin-1 text of its bytes."""
        whole = self.by_text.get(word)
        if whole is not None:
            return [whole]
        compatible = self.compatible
        # longest matches from left to right; right as they are if every border holds
        greedy = [token for _, (_, token) in self.automaton.iter_long(word)]
        for pair in zip(greedy, greedy[1:]):
            if not compatible[pair]:
                break
        else:
            return greedy
        n = len(word)
        longest: list[int | None] = [None] * n
        best = [0] * n
        for end, (size, token) in self.automaton.iter(word):
            at = end - size + 1
            if size > best[at]:
                best[at], longest[at] = size, token
        out: list[int] = []
        open_at = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        length, shorter = self.length, self.shorter
        while True:
            end = at + length[token]
            if open_at[end] and (not out or compatible[out[-1], token]):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = shorter[token]
            if token is None:
                open_at[at] = 0
                token = out.pop()
                at -= length[token]

    def _run(self, run: str) -> bytes:
        words = self.pretoken.findall(run)
        if len(words) == 1:
            return array("I", self.encode_word(run.encode("utf-8").decode("latin-1"))).tobytes()
        return b"".join([self.pieces[w] for w in words])

    def _piece(self, word: str) -> bytes:
        return array("I", self.encode_word(word.encode("utf-8").decode("latin-1"))).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        words = self.words
        if self.split_added is None or not self.split_added.search(text):
            return b"".join([words[r] for r in _RUN.findall(text)])
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [words[r] for r in _RUN.findall(text[at:m.start()])]
            out.append(np.array([self.added[m[0]]], "<u4").tobytes())
            at = m.end()
        out += [words[r] for r in _RUN.findall(text[at:])]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of the ids: one gather from the byte array through the offset table."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(i):
            return ""
        begin = self.offset[i]
        size = self.offset[i + 1] - begin
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        return self.bytes[at].tobytes().decode("utf-8", errors="replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per file and Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<long>, if asked for), ids_sha256, decoded_sha256 of every row.

    ``path`` is the vocabulary file, present on every worker.  Each row is encoded, then
    decoded from its ids.  Null and empty texts have no ids (and the digests of empty input);
    a null doc_id stays null; repeated rows each get a row; other columns are ignored; an
    empty table gives no rows.  There is no shuffle; memory is one Arrow batch and two bounded
    memos a worker.
    """
    def each(batches):
        c = codec(path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                n, ids, enc, dec = [], [], [], []
                for t in part.column(1):
                    coded = c.encode(t.as_py() or "")
                    n.append(len(coded) // 4)
                    enc.append(hashlib.sha256(coded).hexdigest())
                    dec.append(hashlib.sha256(c.decode(coded).encode("utf-8")).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(coded, "<u4").astype(np.int64))
                cols = [part.column(0), pa.array(n, pa.int64())]
                cols += [pa.array(ids, pa.list_(pa.int64()))] if with_ids else []
                cols += [pa.array(enc), pa.array(dec)]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
    schema = "doc_id long, n_tokens long, " + "ids array<long>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(each, schema)
