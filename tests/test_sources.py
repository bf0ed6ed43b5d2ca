"""S1/S2/U1 on small literal CSV files; S3 plan shape."""

import os
import tempfile

from agrolattice.schemas import SOILS
from agrolattice.sources.tables import read_catalog_files, read_csv_table, read_region, write_partitioned


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_with_declared_schema_and_missing_file(spark):
    d = tempfile.mkdtemp(prefix="agrolattice-test-")
    p = os.path.join(d, "soils.csv")
    _write(p, "departamento,municipio,cultivo,latitud,longitud,aptitud,ph_suelo,altitud_m,materia_organica_pct,"
              "pendiente_pct,textura\nHuila,Neiva,Cafe,2.9,-75.3,Alta,5.8,1200,3.5,12,Franco\n")
    df = read_csv_table(spark, p, SOILS)
    r = df.first()
    assert r.ph_suelo == 5.8 and r.altitud_m == 1200.0 and df.schema["altitud_m"].dataType.typeName() == "double"
    empty = read_csv_table(spark, os.path.join(d, "absent.csv"), SOILS)
    assert empty.count() == 0 and empty.columns == df.columns


def test_catalog_files_union_by_name_with_bom_and_quotes(spark):
    d = tempfile.mkdtemp(prefix="agrolattice-test-")
    _write(os.path.join(d, "reto_a.csv"), '﻿UID,Titulo,Número de Filas\nu1,"Café, cacao",8.869\n')
    _write(os.path.join(d, "reto_b.csv"), 'UID,Titulo,alcance_geografico\nu1,"Café, cacao",local\nu2,Otro,nacional\n')
    df = read_catalog_files(spark, sorted(os.path.join(d, f) for f in os.listdir(d)))
    assert set(df.columns) == {"UID", "Titulo", "Número de Filas", "alcance_geografico"}
    rows = sorted(((r.UID, r.Titulo, r["Número de Filas"], r.alcance_geografico) for r in df.collect()),
                  key=lambda t: tuple(x or "" for x in t))
    assert rows == [("u1", "Café, cacao", None, "local"), ("u1", "Café, cacao", "8.869", None),
                    ("u2", "Otro", None, "nacional")]


def test_region_read_prunes_partitions(spark):
    d = tempfile.mkdtemp(prefix="agrolattice-test-")
    df = spark.createDataFrame([("A", 1, 2.0, "x"), ("B", 2, 3.0, "y")], "dept string, k int, v double, junk string")
    write_partitioned(df, os.path.join(d, "t"), "dept")
    out = read_region(spark, os.path.join(d, "t"), "dept", "A", ["k", "v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dept" in plan and "junk" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert [tuple(r) for r in out.collect()] == [(1, 2.0)]


def test_pipeline_reuses_finished_outputs(spark):
    from agrolattice.sources.tables import path_exists, write_table
    d = tempfile.mkdtemp(prefix="agrolattice-test-")
    p = os.path.join(d, "t")
    assert not path_exists(spark, os.path.join(p, "_SUCCESS"))
    write_table(spark.range(3), p)
    assert path_exists(spark, os.path.join(p, "_SUCCESS"))


def test_stored_views_equal_inline_views(spark):
    from pyspark.sql import functions as F

    from agrolattice.sources import standins as si
    sf = "/root/testdata/sf0.001"
    saved = si.MATERIALIZE_VIEWS
    try:
        si.MATERIALIZE_VIEWS = False
        inline = si.production(spark, sf)
        si.MATERIALIZE_VIEWS = True
        stored = si.production(spark, sf)
    finally:
        si.MATERIALIZE_VIEWS = saved
    def digest(df):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash(*df.columns)).alias("h")).first()
    assert digest(inline) == digest(stored)
    assert stored.schema == inline.schema


def test_regional_extract_round_trip_keeps_tricky_texts(spark):
    from agrolattice.plans.pipeline import extract_by_department
    d = tempfile.mkdtemp(prefix="agrolattice-test-")
    rows = [("u1", 'dice "hola"', "A"), ("u2", "barra \\ y \\\"comillas\\\"", "A"), ("u3", "línea 1\nlínea 2", "B"),
            ("u4", 'coma, "y" salto\r\nfinal', "B"), ("u5", "normal", None)]
    df = spark.createDataFrame(rows, "UID string, Titulo string, dept string")
    got = {r.departamento: r.rows for r in extract_by_department(df, os.path.join(d, "x"), "dept").collect()}
    assert got == {"A": 2, "B": 2, "Nacional": 1}


def test_csv_columns_by_name(spark):
    d = tempfile.mkdtemp(prefix="agrolattice-test-")
    p = os.path.join(d, "prices.csv")
    _write(p, '﻿cultivo,fecha,otro,precio_kg_promedio_cop\nCafe,2024-01-01,x,12.5\nCacao,bad,y,n/a\n')
    df = read_csv_table(spark, p, "fecha date, cultivo string, central_abasto string, precio_kg_promedio_cop double")
    assert [tuple(map(str, r)) for r in df.collect()] == [("2024-01-01", "Cafe", "None", "12.5"), ("None", "Cacao", "None", "None")]


def test_checkpoint_dir_is_required_off_local_mode(monkeypatch, spark):
    import pytest
    from agrolattice import session

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_gap_fill_leaves_rows_without_a_group(spark):
    from agrolattice.operators.gapfill import gap_fill_linear
    rows = [(g, i, v) for g in ("a", None) for i, v in enumerate([1.0, None, 3.0, None])]
    got = gap_fill_linear(spark.createDataFrame(rows, "g string, t int, v double"), ["g"], ["t"], ["v"]).orderBy("g", "t").collect()
    assert [r["v"] for r in got if r["g"] == "a"] == [1.0, 2.0, 3.0, 3.0]
    assert [r["v"] for r in got if r["g"] is None] == [None] * 4
