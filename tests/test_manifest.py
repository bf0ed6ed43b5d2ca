"""Tables are rebuilt only if what they are made from changed; broken writes are not read."""

import os
import tempfile

import pytest

from agrolattice.plans import pipeline as P
from agrolattice.sources import standins as si

SF = "/root/testdata/sf0.001"


def test_publish_replaces_whole_tables(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="agrolattice-test-"), "t")
    assert P.read_manifest(spark, path) is None
    P.publish(spark.range(3), path, {"v": 1})
    P.publish(spark.range(5), path, {"v": 2})
    assert spark.read.parquet(path).count() == 5 and P.read_manifest(spark, path) == {"v": 2}
    with pytest.raises(Exception):
        P.publish(spark.range(9).selectExpr("if(id = 8, raise_error('broken'), id) as id"), path, {"v": 3})
    assert spark.read.parquet(path).count() == 5 and P.read_manifest(spark, path) == {"v": 2}


def test_only_what_depends_on_a_change_is_rebuilt(spark):
    base = tempfile.mkdtemp(prefix="agrolattice-test-")
    names = ["production", "soils", "climate", "credit", "prices", "land", "livestock", "catalog_raw"]
    views = [si.production, si.soils, si.climate_daily, si.credit, si.prices_weekly, si.land_security, si.livestock, si.catalog_raw]
    for name, view in zip(names, views):
        view(spark, SF).limit(60).coalesce(1).write.parquet(os.path.join(base, "in", name))
    out = os.path.join(base, "out")
    read = lambda: {n: spark.read.parquet(os.path.join(base, "in", n)) for n in names}
    run = lambda **kw: P.run_pipeline(spark, out, **read(), climate_order=["fecha", "seq"], reuse=True, **kw)
    times = lambda: {n: os.stat(os.path.join(out, n, "_manifest.json")).st_mtime_ns for n in P.DEPENDS}
    changed = lambda a, b: {n for n in a if a[n] != b[n]}
    first = {n: df.count() for n, df in run().items()}
    t0 = times()
    assert {n: df.count() for n, df in run().items()} == first and times() == t0
    si.prices_weekly(spark, SF).limit(90).coalesce(1).write.mode("append").parquet(os.path.join(base, "in", "prices"))
    run()
    t1 = times()
    assert changed(t0, t1) == {"precios_sipsa_anual", "consolidated_data"}
    os.remove(os.path.join(out, "inventario_ganadero_anual", "_manifest.json"))  # as a broken write leaves it
    run()
    assert changed(t1, times()) == {"inventario_ganadero_anual"}
    run(version="2")
    assert changed(t1, times()) == set(P.DEPENDS)


def test_frames_without_files_have_no_stamp(spark):
    assert P.input_stamp(spark.range(3)) is None
