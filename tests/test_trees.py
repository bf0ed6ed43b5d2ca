"""Learners, exact parts and the feature stage against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from agrolattice.operators import trees as T
from agrolattice.operators.stratify import rank_cuts, row_hash, stratified
from agrolattice.operators.tfidf import tfidf_long
from agrolattice.plans.models import TfidfVectors, logistic_fit, yield_cells


def cells_of(x, y, weight=None, bins=255):
    cuts = [T.cuts_of(x[:, f], bins) for f in range(x.shape[1])]
    w = np.ones(len(y)) if weight is None else weight
    return T.Cells(T.binned(x, cuts), w, y * w, cuts)


def plain_boost(x, y, rounds, depth, leaves, rate, least):
    """Leaf-wise boosting by scanning every cut of every open leaf."""
    raw = np.full(len(y), y.mean())
    for _ in range(rounds):
        g, leaf, level = y - raw, np.zeros(len(y), int), {0: 0}
        while len(level) < leaves:
            best = (1e-12, None)
            for node, at_level in level.items():
                rows = leaf == node
                if at_level >= depth:
                    continue
                for f in range(x.shape[1]):
                    values = np.unique(x[rows, f])
                    for c in (values[1:] + values[:-1]) / 2:
                        low = rows & (x[:, f] <= c)
                        high = rows & ~low
                        if min(low.sum(), high.sum()) >= least:
                            gain = g[low].sum() ** 2 / low.sum() + g[high].sum() ** 2 / high.sum() - g[rows].sum() ** 2 / rows.sum()
                            if gain > best[0] + 1e-9:
                                best = (gain, (node, high))
            if best[1] is None:
                break
            node, high = best[1]
            new = max(level) + 1
            level[node] += 1
            level[new] = level[node]
            leaf[high] = new
        for node in level:
            raw[leaf == node] += rate * g[leaf == node].mean()
    return raw


def test_booster_against_a_plain_one():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (120, 3)).astype(float)
    y = x[:, 0] * 2 - (x[:, 1] > 4) * x[:, 2] + rng.normal(size=120)
    start, found = T.boost(cells_of(x, y), 6, 4, leaves=6, rate=0.3, least_rows=5)
    model = T.Model(found, start, boosted=True)
    assert np.allclose(model.predict(x), plain_boost(x, y, 6, 4, 6, 0.3, 5))
    # rows summed by equal bins train the same model
    keys, at, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    summed = cells_of(x, y)
    summed = T.Cells(T.binned(keys, summed.cuts), n.astype(float), np.bincount(at.ravel(), y), summed.cuts)
    start2, again = T.boost(summed, 6, 4, leaves=6, rate=0.3, least_rows=5)
    assert np.allclose(T.Model(again, start2, boosted=True).predict(x), model.predict(x))


def test_booster_stops_early_and_learns_classes():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=800)) > 0).astype(float)
    train, held = cells_of(x[:600], y[:600]), None
    held = T.Cells(T.binned(x[600:], train.cuts), np.ones(200), y[600:], train.cuts)
    start, found = T.boost(train, 500, 5, logistic=True, held=held)
    model = T.Model(found, start, True, True)
    assert len(found) < 500 and ((model.predict(x[600:]) > 0.5) == y[600:]).mean() > 0.85


@pytest.mark.parametrize("random_cut", [False, True])
def test_trees_split_as_chosen(random_cut):
    """Each inner node's children hold the means of the rows that its cut sends there; exhaustive
    trees take the best cut of all."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 6, (80, 3)).astype(float)
    y = (x[:, 0] > 2) * 1.0 + x[:, 2] * 0.1
    tree = T.grow(cells_of(x, y), np.ones(80), y, 4, 3, rng, random_cut)
    rows = {0: np.arange(80)}
    for node, f in enumerate(tree.feature):
        here = rows[node]
        assert np.isclose(tree.value[node], y[here].mean())
        if f >= 0:
            above = x[here, f] > tree.cut[node]
            rows[tree.below[node]], rows[tree.above[node]] = here[~above], here[above]
            sse = lambda r: ((y[r] - y[r].mean()) ** 2).sum() if len(r) else 0.0
            gained = sse(here) - sse(here[above]) - sse(here[~above])
            assert np.isclose(gained, tree.gain[node]) and 0 < above.sum() < len(here)
            if not random_cut:
                every = [sse(here) - sse(here[x[here, g] > c]) - sse(here[x[here, g] <= c]) for g in range(3) for c in np.arange(0.5, 5)]
                assert np.isclose(gained, max(every))
    if random_cut:
        other = T.grow(cells_of(x, y), np.ones(80), y, 4, 3, np.random.default_rng(8), True)
        assert other.cut != tree.cut


def test_stratified_parts(spark):
    rows = [(f"k{i}", ["a", "b", None][i % 7 % 3]) for i in range(997)]
    got = stratified(spark.createDataFrame(rows, "key string, cls string"), "key", "cls").collect()
    h = lambda salt, k: hashlib.md5(f"{salt}|{k}".encode()).hexdigest()
    for cls in ("a", "b", None):
        mine = sorted((h("split42", k), k) for k, c in rows if c == cls)
        test = {k for _, k in mine[:int(0.2 * len(mine) + 0.5)]}
        assert {r["key"] for r in got if r["cls"] == cls and r["part"] == "test"} == test
        for part in ("test", "train"):
            dealt = sorted((h("fold42", r["key"]), r["fold"]) for r in got if r["cls"] == cls and r["part"] == part)
            assert [f for _, f in dealt] == sorted(f for _, f in dealt)
            sizes = [sum(f == i for _, f in dealt) for i in range(5)]
            assert max(sizes) - min(sizes) <= 1


def test_rank_cuts_narrow_by_prefixes(spark):
    df = spark.range(3000).select(F.lit("x").alias("g"), row_hash("id", "s").alias("h"))
    want = sorted(hashlib.md5(f"s|{i}".encode()).hexdigest() for i in range(3000))
    assert rank_cuts(df, "g", "h", {"x": [1, 777, 3000]}, most=1) == {("x", r): want[r - 1] for r in (1, 777, 3000)}


def test_feature_stage_equals_tfidf(spark, tmp_path):
    rows = [(1, "the cat sat on the mat"), (2, "the dog 42"), (3, ""), (4, "cat cat dog"), (5, None)]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("t", F.coalesce("t", F.lit("")))
    model = Pipeline(stages=[TfidfVectors("t", "x", 4)]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    want = {(r["id"], r["term"]): r["weight"] for r in tfidf_long(df, "id", "t", 4).collect()}
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        vocabulary = m.stages[0].stages[1].vocabulary
        got = {(r["id"], vocabulary[i]): v for r in m.transform(df).collect() for i, v in enumerate(r["_vec_x"].toArray()) if v}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_tfidf_counts_in_one_pass(spark):
    rows = [(1, "b a b cc cc"), (1, "cc dd"), (None, "dd dd ee"), (2, None), (3, "? x"), (4, " ".join(f"w{i % 12} w0" for i in range(60)))]
    df = spark.createDataFrame(rows, "id int, t string")
    out = tfidf_long(df, "id", "t", 40)
    got = sorted((str(r["id"]), r["term"], r["tf"], round(r["weight"], 9)) for r in out.collect())
    counts = [(i, Counter(w for w in (t or "").split() if len(w) > 1)) for i, t in rows]
    seen = Counter(w for _, c in counts for w in c)
    want = []
    for i, c in counts:
        w = {t: n * (np.log(7 / (1 + seen[t])) + 1) for t, n in c.items()}
        want += [(str(i), t, c[t], round(w[t] / np.sqrt(sum(x * x for x in w.values())), 9)) for t in w]
    assert got == sorted(want)
    plan = out._jdf.queryExecution().toString()
    assert "array_remove" not in plan and "INSET" in plan.upper()
    assert tfidf_long(df.where("id = 3"), "id", "t", 40).count() == 0
    assert tfidf_long(df.where("id = 3"), "id", "t", 40).dtypes == out.dtypes


def test_cells_hold_every_row(spark):
    df = spark.range(500).selectExpr("'c' || id % 3 as cultivo", "'t' as textura", *[f"cast(id * {k + 1} % 97 as double) as {c}" for k, c in enumerate(
        ["ph_suelo", "altitud_m", "pendiente_pct", "materia_organica_pct", "temp_media_c", "precipitacion_anual_mm"])], "id * 1.0D as label", "id % 2 as flag")
    for most in (10_000, 60):
        levels, cuts, frame, table = yield_cells(df, ["flag"], most_cells=most)
        assert frame["n"].sum() == 500 and frame["s"].sum() == 500 * 499 / 2 and len(frame) <= most and len(cuts) == table.shape[1]
    assert levels["cultivo"] == ["c0", "c1", "c2"]


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(float)
    w = logistic_fit(x, y)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert np.allclose(w, [0.5, 1.0, -2.0], atol=0.25) and np.allclose(x.T @ (y - p), w[1:], atol=1e-6)
