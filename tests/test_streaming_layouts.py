"""Streams give the same rows whatever the file layout, and a restarted run resumes."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from agrolattice.streaming import rollups as R

EVENTS = "/root/testdata/sf0.001/events.parquet"


def _daily(spark, folder, **kw):
    return R.daily_rollup(R.station_stream(spark, folder, "*.parquet", **kw))


@pytest.fixture(scope="module")
def layouts(spark):
    base = tempfile.mkdtemp(prefix="agrolattice-test-")
    one, many = os.path.join(base, "one"), os.path.join(base, "many")
    events = spark.read.parquet(EVENTS)
    events.coalesce(1).write.parquet(one)
    events.orderBy(F.xxhash64("event_id")).repartition(150).write.parquet(many)
    return one, many


def test_one_file_and_many_files_agree(spark, layouts):
    rows = [sorted(map(str, R.run_available_now(_daily(spark, d), "t").withColumn("precipitacion_mm", F.round("precipitacion_mm", 6))
                       .select("window", "municipio", "precipitacion_mm").collect())) for d in layouts]
    assert rows[0] == rows[1] and len(rows[0]) > 300


def test_rows_dropped_by_the_watermark_are_an_error(spark, layouts):
    with pytest.raises(RuntimeError, match="watermark"):
        R.run_available_now(_daily(spark, layouts[1], max_files_per_trigger=20), "t")


def test_restart_resumes(spark, layouts):
    run = os.path.basename(tempfile.mktemp())
    first = R.run_available_now(_daily(spark, layouts[0]), "t", run_id=run).count()
    assert R.run_available_now(_daily(spark, layouts[0]), "t", run_id=run).count() == first
