"""op7: base counts against brute force, verdicts on labelled rows, odd rows."""

import re

import numpy as np

from agrolattice.llm.quality import BASE, choose_threshold, keep_good, quality_verdicts, repeat_words, rule_statistics

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_base_counts(sf_docs):
    for r in sf_docs.collect():
        if len(r["text"] or "") < 20_000:
            assert rule_statistics(r["text"])[0] == brute(r["text"])
    for text in (None, "", " \n\t", "a b c d e f g h " * 4, "x\n x\nx\n\n \n", "a b c"):
        assert rule_statistics(text)[0] == brute(text)


def test_repeat_words_random():
    rng = np.random.default_rng(2)
    for _ in range(200):
        words = [str(x) for x in rng.integers(0, 2, int(rng.integers(0, 60)))]
        assert repeat_words(words) == brute(" ".join(words))[4]


def test_junk_goes_and_clean_stays(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_verdicts(docs, labels).join(labels, "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_odd_rows(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(40))
    docs = make_docs([(1, None), (2, ""), (3, text), (3, text), (None, text), (4, "a b " * 4000)], extra=True)
    got = quality_verdicts(docs, spark.createDataFrame([], LABELS)).select("doc_id", *BASE, "base_failed", "kept").collect()
    assert sorted((str(r["doc_id"]), r["kept"]) for r in got) == [
        ("1", False), ("2", False), ("3", True), ("3", True), ("4", False), ("None", True)]
    kept = keep_good(docs, spark.createDataFrame([(3, None, None), (None, 0, 0)], LABELS))
    assert kept.columns == docs.columns and kept.count() == 3
    assert quality_verdicts(make_docs([]), spark.createDataFrame([], LABELS)).count() == 0


def test_threshold():
    assert choose_threshold([(100, 1, 1000), (900, 0, 10)], 0.01) == 900
    assert choose_threshold([(100, 1, 10)], 0.01) == 1001
