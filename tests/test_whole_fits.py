"""Models are fitted on all rows, in the same bins whatever their number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolattice.operators import trees as T
from agrolattice.plans import models as M


def test_viability_is_fitted_on_every_row(spark, monkeypatch):
    n = 20_500  # more than the 20,000 rows that were taken before
    names = ["a", "b"]
    rng = np.random.default_rng(1)
    cat = spark.range(n).select(F.col("id").cast("string").alias("UID"), (F.col("id") % 3 == 0).alias("es_viable"), (F.col("id") % 3 == 0).cast("double").alias("label"),
                                *[(F.col("id") * k % 11).cast("double").alias(c) for k, c in enumerate(names, 1)],
                                *[F.lit("").alias(f"_txt_{c}") for c in ("title", "desc", "just")])

    class Plain:
        def fit(self, df):
            return self

        def transform(self, df):
            from pyspark.ml.feature import VectorAssembler
            return VectorAssembler(inputCols=names, outputCol="features").transform(df)

    monkeypatch.setattr(M, "FEATURE_NAMES", names)
    monkeypatch.setattr(M, "prepare_catalog", lambda df: df)
    monkeypatch.setattr(M, "viability_featurizer", Plain)
    seen, fit = [], M.fit_units
    monkeypatch.setattr(M, "fit_units", lambda s, cells, units, run: seen.append(cells) or fit(s, cells, units, run))
    _, bases, meta, metrics = M.train_viability(cat, n_trees=2, gbt_iter=2, folds=2, refit=False)
    assert len(seen[0].weight) == n and seen[0].label_sum.sum() == (n + 2) // 3
    assert metrics.first()["n_test"] == 4100 and len(bases["rf"].trees) == 2 and len(meta) == 4 and rng is not None


def test_cuts_and_bins_of_a_table(spark):
    rng = np.random.default_rng(2)
    x = np.stack([rng.normal(size=3000), rng.integers(0, 9, 3000).astype(float), np.zeros(3000)], 1)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>").repartition(5)
    cuts = T.table_cuts(df, "x", 3000)
    want = [T.cuts_of(x[:, f]) for f in range(3)]
    assert all(np.array_equal(a, b) for a, b in zip(cuts, want, strict=True))
    got = {r["id"]: r["bins"] for r in T.with_bins(df, "x", cuts).collect()}
    assert np.array_equal(np.stack([np.frombuffer(got[i], np.uint8) for i in range(3000)]), T.binned(x, want))


@pytest.mark.parametrize("random_cut", [False, True])
def test_trees_do_not_depend_on_the_blocks(monkeypatch, random_cut):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 40, (900, 6)).astype(float), rng.integers(0, 2, 900).astype(float)
    cuts = [T.cuts_of(x[:, f]) for f in range(6)]
    cells = T.Cells(T.binned(x, cuts), np.ones(900), y, cuts)
    grown = lambda: T.grow(cells, np.ones(900), y, 9, 3, np.random.default_rng(4), random_cut)
    start, boosted = T.boost(cells, 5, 5, logistic=True)
    plain = grown()
    monkeypatch.setattr(T, "_ROWS", 37)
    monkeypatch.setattr(T, "_ENTRIES", 300)
    assert grown() == plain and len(plain.feature) > 100
    again = T.boost(cells, 5, 5, logistic=True)[1]
    assert [t.feature for t in again] == [t.feature for t in boosted]


def test_yield_cells_have_the_same_bins_for_any_number(spark):
    cols = M.YIELD_NUMERIC
    df = spark.range(230_000).select(F.lit("c").alias("cultivo"), F.lit("t").alias("textura"), F.lit(1.0).alias("label"), F.lit(0).alias("flag"),
                                     *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(300)).cast("double")).alias(c) for i, c in enumerate(cols)])
    _, cuts, frame, table = M.yield_cells(df, ["flag"])
    assert len(frame) > 200_000 and frame["n"].sum() == 230_000 and min(len(c) for c in cuts[2:]) > 200
