"""op8 against brute force, both ways of finding repeats, and the suffix array itself."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from agrolattice.llm.suffix_dedup import common_prefixes, suffix_array, without_repeats


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = 1
        gone = gone[:len(b)]
        runs = int(((gone == 1) & (np.concatenate(([0], gone[:-1])) == 0)).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        data = rng.integers(20, 20 + letters, int(rng.integers(1, 300))).astype(np.uint8)
        b, order = data.tobytes(), suffix_array(data, 300)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        for x, (i, j) in zip(common_prefixes(data, order, 300)[1:], zip(order, order[1:])):
            assert b[i:i + x] == b[j:j + x] and (x + max(i, j) == len(b) or b[i + x] != b[j + x])


@pytest.mark.parametrize("most_parts", [4000, 1])
def test_matches_brute_force(make_docs, sf_docs, most_parts):
    texts = [r["text"] for r in sf_docs.collect() if len(r["text"] or "") < 20_000]
    whole = texts[0] * 3
    texts += [None, "", "a" * 199, "a" * 200, "a" * 201, "ab" * 300, "é" * 150 + "q" + "é" * 150, whole, whole[:700] + "x" + whole[100:900],
              texts[3], texts[3], texts[4][50:], "x" + texts[4][:260] + "y", "\x00" * 250]
    rng = np.random.default_rng(0)
    texts += ["".join(rng.choice(list("ab"), 300)) + texts[5][:250] for _ in range(12)]
    got = {r["doc_id"]: r for r in without_repeats(make_docs(list(enumerate(texts)), extra=True), most_parts=most_parts).collect()}
    want = brute(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == w, i


def test_repeated_rows_and_empty_table(make_docs):
    text = " ".join(f"w{i}" for i in range(100))
    got = without_repeats(make_docs([(1, text), (1, text), (None, "x" * 150), (None, "x" * 150)])).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 0, len(text), len(text)]
    assert without_repeats(make_docs([])).count() == 0


def test_long_text_in_pieces(make_docs):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefgh "), 1_300_000))
    text = text[:1_200_000] + text[500:1500] + text[1_200_000:]
    r = without_repeats(make_docs([text])).first()
    assert (r["n_removed"], r["n_spans"]) == (2000, 2)
