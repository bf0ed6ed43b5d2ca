"""op4: exact neighbours against brute force, held-out accuracy, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from agrolattice.llm.toxicity import BlockMaxIndex, KnownTerms, calibration, held_out, terms_of, toxicity_scores

LABELS = "doc_id long, quality int, toxic int"


def test_block_max_index_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(20):
        rows = np.where(rng.random((150, 40)) < 0.2, rng.random((150, 40)), 0)
        rows[30:40] = rows[30]  # ties
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        index = BlockMaxIndex([{t: w for t, w in enumerate(r) if w} for r in rows], 40, block=16)
        q = np.where(rng.random(40) < 0.3, rng.random(40), 0)
        terms = np.flatnonzero(q)
        who, cos = index.nearest(terms, q[terms], 12, skip=3)
        full = rows.astype(np.float32) @ q
        full[3] = 0
        want = [i for i in np.lexsort((np.arange(150), -full.round(5))) if full[i] > 0][:12]
        assert np.allclose(cos, full[want], atol=1e-5) and len(set(who)) == len(who) and 3 not in who


def test_known_terms_are_those_of_the_words():
    texts = ["abc abcd abcde abcdef ABCDEFG", "\u00e9t\u00e9 \u00e9t\u00e9s abcdxyz x1y", "", None, "q" * 90 + " abcdef"]
    every = sorted({t for x in texts for t in terms_of(x)})
    for vocabulary in (every, every[::2], every[1::3], []):
        known = KnownTerms({t: t for t in vocabulary}, most=2)
        for x in texts:
            words = {w for w in terms_of(x) if not w.endswith("~")}
            got = {t for w in words if w[:4] in known.begins for t in known[w]}
            assert got == set(terms_of(x)) & set(vocabulary) and len(known) <= 2


def test_blocks_are_scored_in_few_steps():
    rng = np.random.default_rng(1)
    rows = np.where(rng.random((400, 60)) < 0.2, rng.random((400, 60)), 0)
    vectors = [{t: w for t, w in enumerate(r) if w} for r in rows]
    q = np.where(rng.random(60) < 0.3, rng.random(60), 0)
    terms = np.flatnonzero(q)
    found = [BlockMaxIndex(vectors, 60, block=8, at_once=n).nearest(terms, q[terms], 20) for n in (1, 3, 50)]
    for who, cos in found[1:]:
        assert (who == found[0][0]).all() and (cos == found[0][1]).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity_scores(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    s, p, y = (np.array([r[i] for r in rows]) for i in range(3))
    order = np.argsort(np.argsort(s, kind="stable"))
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.93 and (p[y == 1] == 1).mean() > 0.85 and (p[y == 0] == 1).mean() < 0.03
    assert ((s >= 0.3) == (p == 1)).all() and (0 <= s).all() and (s <= 1).all()


def test_labels_of_held_out_rows_and_odd_rows(spark, make_docs):
    ids = list(range(400))
    texts = [("awful nasty " if i % 3 == 0 else "kind gentle ") + f"word{i % 7} filler" for i in ids]
    docs = make_docs([*zip(ids, texts), (None, "awful nasty"), (900, None), (901, ""), (1, "kind gentle word1 filler")], extra=True)
    label = [(i, 1, int(i % 3 == 0)) for i in ids]
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in label] + [(None, 1, 1), (5, None, None)]
    rows = lambda labels: sorted((str(r["doc_id"]), r["score"]) for r in toxicity_scores(docs, spark.createDataFrame(labels, LABELS)).collect())
    assert rows(label) == rows(flipped) and len(rows(label)) == 404
    one = toxicity_scores(docs, spark.createDataFrame([(1, 1, 0)], LABELS))
    assert {r["score"] for r in one.collect()} == {0.0}
    assert toxicity_scores(make_docs([]), spark.createDataFrame([], LABELS)).count() == 0
    got = {r["doc_id"]: r["h"] for r in spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}
    assert spark.range(1).select(F.lit(None).cast("long").alias("doc_id")).select(held_out()).first()[0] is False


def test_calibration_never_falls():
    c = calibration([(0, 0, 50), (10, 1, 1), (20, 0, 9), (150, 1, 30), (199, 0, 1)])
    assert len(c) == 201 and all(a <= b + 1e-12 for a, b in zip(c, c[1:])) and c[0] < 0.1 < 0.8 < c[199]
