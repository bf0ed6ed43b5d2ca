"""Rows between the same cuts are scored once, and each row gets what its trees say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolattice.operators import trees as T
from agrolattice.plans.models import YieldModel, predict_yield


def some_models(rng, features=3):
    x = rng.normal(size=(400, features)).round(1)
    y = x[:, 0] * 2 + (x[:, 1] > 0) + rng.normal(size=400)
    cuts = [T.cuts_of(x[:, f], 12) for f in range(features)]
    cells = T.Cells(T.binned(x, cuts), np.ones(400), y, cuts)
    start, trees = T.boost(cells, 8, 4, leaves=9)
    grown = [T.grow(cells, np.ones(400), y, 5, 2, rng) for _ in range(4)]
    return {"rf": T.Model(grown), "gbt": T.Model(trees, start, True)}


@pytest.mark.parametrize("most", [0, 7, 10_000])
def test_scores_equal_the_trees(most):
    rng = np.random.default_rng(5)
    models = some_models(rng)
    cuts = sorted({c for m in models.values() for t in m.trees for f, c in zip(t.feature, t.cut) if f == 0})
    kept = T.CellScores(models, most)
    for n in (1, 300, 300):
        rows = rng.normal(size=(n, 3)).round(1)
        rows[rng.random((n, 3)) < 0.1] = np.nan
        rows[:1, 0], rows[1:2, 0], rows[2:3, 0] = cuts[0], np.nextafter(cuts[0], np.inf), np.inf
        np.testing.assert_array_equal(kept.predict(rows), np.stack([m.predict(rows) for m in models.values()], 1))
    assert len(kept.known) <= most


def test_a_cell_is_walked_once(monkeypatch):
    models = some_models(np.random.default_rng(6))
    walked = []
    plain = T.Model.predict
    monkeypatch.setattr(T.Model, "predict", lambda self, rows: walked.append(len(rows)) or plain(self, rows))
    kept, rows = T.CellScores(models, 1000), np.tile([[0.1, 0.2, 0.3], [-1.0, 2.0, 0.0]], (500, 1))
    kept.predict(rows)
    kept.predict(rows)
    assert walked == [2, 2]  # two cells, once for each model


def test_yield_predictions_go_by_cells(spark, monkeypatch):
    names = ["ph_suelo", "altitud_m", "pendiente_pct", "materia_organica_pct", "temp_media_c", "precipitacion_anual_mm"]
    rng = np.random.default_rng(7)
    model = YieldModel({"cultivo": [], "textura": []}, some_models(rng, len(names)))
    rows = [(i, "a", "b", *[float(v) for v in rng.normal(size=len(names)).round(1)]) for i in range(200)]
    df = spark.createDataFrame(rows, ["id", "cultivo", "textura", *names]).repartition(3)
    got = {r["id"]: r["prediction"] for r in predict_yield(model, df).collect()}
    x = np.array([r[3:] for r in rows])
    want = (model.models["rf"].predict(x) + model.models["gbt"].predict(x)) / 2
    assert got == {i: w for i, w in enumerate(want)}
    assert predict_yield(model, df.where(F.lit(False))).count() == 0
