"""op6 against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from agrolattice.llm.bpe import Codec, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", " ", "  ", "\n", "\t", "é", "漢", "😀", "'s", "'ll", "12", "٣", "<|endoftext|>", "\xa0", "\x85", "\x1c", "​",
       "　", "tion", "THE", "!!", "\r\n", "x" * 30, "\x00", "́", "<|endoftext"]


def test_random_texts_match_the_library():
    codec, library, rng = Codec(PATH, memo=50), Tokenizer.from_file(PATH), random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 25)))
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(codec.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


def test_documents_match_the_library(sf_docs):
    library = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r for r in encode_documents(sf_docs, PATH).collect()}
    assert len(got) == sf_docs.count()
    for r in sf_docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        row = got[r["doc_id"]]
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_nulls_repeats_and_empty_tables(make_docs):
    got = encode_documents(make_docs([(1, None), (1, None), (None, "a b"), (2, "")], extra=True), PATH).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 0, 2]
    assert encode_documents(make_docs([]), PATH).count() == 0


def test_memo_keeps_no_long_runs():
    from agrolattice.llm.bpe import _Bounded
    memo = _Bounded(len, 3)
    assert [memo["x" * n] for n in (1, 64, 65, 100_000, 64)] == [1, 64, 65, 100_000, 64] and sorted(map(len, memo)) == [1, 64]
