"""The registered model queries train the whole models, on titles by the catalog's rule."""

import pytest

from agrolattice import queries as Q


class Trained(Exception):
    pass


@pytest.mark.parametrize("name", ["viability_metrics", "viability_scores", "importances", "yield_metrics", "yield_scores", "model_roundtrip",
                                  "best_month_ml", "hybrid_rmse"])
def test_library_defaults(monkeypatch, name):
    def train(data, **options):
        raise Trained(options)

    for f in ("train_viability", "train_yield", "hybrid_models"):
        monkeypatch.setattr(Q.model_plan, f, train)
    monkeypatch.setattr(Q, "_catalog", lambda *a: None)
    monkeypatch.setattr(Q, "_master_for_model", lambda *a: None)
    with pytest.raises(Trained) as got:
        Q.QUERIES[name](None, "")
    assert got.value.args == ({},)


def test_title_of_a_benchmark_text(spark, monkeypatch):
    cat = spark.createDataFrame([("u", "t", "d")], "UID string, Titulo string, `Descripción` string")
    text = "first line " * 12 + "\nsecond"
    monkeypatch.setattr(Q, "_catalog", lambda *a: cat)
    monkeypatch.setattr(Q.si, "read_table", lambda *a: spark.createDataFrame([(1, text)], "item_id long, text string"))
    monkeypatch.setattr(Q.model_plan, "train_viability", lambda *a, **k: (None,) * 4)
    monkeypatch.setattr(Q.model_plan, "score_viability", lambda reqs, *a: reqs)
    monkeypatch.setattr(Q, "rounded", lambda df: df)
    got = {r["UID"]: r["Titulo"] for r in Q.QUERIES["viability_scores"](spark, "").collect()}
    assert got == {"bench-1": "first line " * 12, "u": "t"}
