"""A feed's late rows are kept and merged, and its predictions equal the batch plan."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from agrolattice.plans.planner import sowing_plan
from agrolattice.sources import standins as si
from agrolattice.streaming.feeds import ClimateFeed, Predictions
from agrolattice.streaming.rollups import MEASURES

SF = "/root/testdata/sf0.001"
SCHEMA = "departamento string, municipio string, ts timestamp, " + ", ".join(f"{m} double" for m in MEASURES)


def reading(day, rain, place="M1", temp=20.0):
    return ("D1", place, dt.datetime(2024, 1, day, 12), temp, rain, None, 1.0)


def rain_by_day(df):
    return {(r["day"].day, r["municipio"]): r["precipitacion_mm"] for r in df.collect()}


def test_late_rows_go_to_their_table_and_are_merged(spark):
    feed = ClimateFeed(spark, "test-late")
    batches = [[reading(1, 1.0), reading(9, 2.0)], [reading(1, 4.0), reading(8, 8.0), ("D1", None, None, 1.0, 1.0, 1.0, 1.0)]]
    for i, rows in enumerate(batches):
        feed.absorb(spark.createDataFrame(rows, SCHEMA), i)
    assert [(r["ts"].day, r["batch_id"]) for r in feed.late_rows().collect()] == [(1, 1)]
    assert rain_by_day(feed.closed_days(repaired=False)) == {(1, "M1"): 1.0}
    assert rain_by_day(feed.closed_days()) == {(1, "M1"): 5.0}
    feed.absorb(spark.createDataFrame(batches[1], SCHEMA), 1)  # the batch runs again
    assert rain_by_day(feed.closed_days()) == {(1, "M1"): 5.0} and feed.late_rows().count() == 1
    feed.absorb(spark.createDataFrame([], SCHEMA), 2)
    assert rain_by_day(feed.closed_days()) == {(1, "M1"): 5.0}


def test_an_empty_feed_has_no_days(spark):
    feed = ClimateFeed(spark, "test-empty")
    assert feed.closed_days().count() == 0 and feed.late_rows().count() == 0 and feed.calibration().count() == 0


@pytest.fixture(scope="module")
def landed(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="agrolattice-test-"), "climate")
    climate = si.climate_daily(spark, SF)
    climate.select("departamento", "municipio", F.col("fecha").cast("timestamp").alias("ts"), *MEASURES) \
        .orderBy(F.xxhash64("seq")).repartition(4).write.parquet(d)
    return d


def test_predictions_follow_the_feed(spark, landed):
    production, parcels = si.production(spark, SF), si.parcels(spark, SF)
    wide = parcels.limit(3).withColumn("parcel_id", -F.col("parcel_id")).withColumn("municipio", F.lit("Todos"))
    parcels = parcels.unionByName(wide).unionByName(
        parcels.limit(1).withColumn("parcel_id", F.lit(10 ** 6).cast("long")).withColumn("municipio", F.lit("nowhere")))
    cols = ["best_month", "best_yield", "data_source"]
    feed = ClimateFeed(spark, "test-plan")
    table = Predictions(feed, parcels, lambda r, c: sowing_plan(r, None, production, calibration=c), "parcel_id", cols).start()
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).option("maxFilesPerTrigger", 2).parquet(landed)
    feed.run(stream, table.update)
    got = {r["parcel_id"]: (r["best_month"], r["best_yield"], r["data_source"]) for r in table.latest().collect()}
    want = {r["parcel_id"]: (r["best_month"], r["best_yield"], r["data_source"])
            for r in sowing_plan(parcels, si.climate_daily(spark, SF), production).select("parcel_id", *cols).collect()}
    assert got == want
    batch = {r["parcel_id"]: r["batch_id"] for r in table.latest().collect()}
    assert batch[10 ** 6] == -1 and max(batch.values()) == 1


def test_only_touched_requests_are_scored_again(spark):
    feed = ClimateFeed(spark, "test-touch")
    feed.absorb(spark.createDataFrame([reading(1, 1.0)], SCHEMA), 0)
    rows = [(1, "D1", "M1"), (2, "D1", "M2"), (3, "d1", "Todos"), (4, "D2", "Todos"), (5, "Todos", "Todos"), (6, None, None)]
    requests = spark.createDataFrame(rows, "k int, departamento string, municipio string")
    assert sorted(r["k"] for r in Predictions(feed, requests, None, "k", []).touched(0).collect()) == [1, 3, 5, 6]
