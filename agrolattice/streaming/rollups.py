"""Structured Streaming roll-ups of live feeds.

X1: station readings arrive as files; an event-time watermark of 2 days bounds the state,
tumbling 1-day windows per place carry the same measures as the yearly batch roll-up (A1).
Append mode emits a window once the watermark passes its end.  Gap filling needs the whole
ordered series, so it stays in the batch job (W1), which re-runs over the landed data.

X2: market prices as sliding 28-day windows every 7 days per crop (a time-based moving
average; grouping by window is a partial aggregate, so a hot crop is no problem).

Both sinks write parquet under the shared checkpoint folder with their own checkpoint
location; a run started again with the same ``run_id`` resumes from the last committed batch.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

def wall_to_instant(c: Column, session_tz: str) -> Column:
    """A wall-clock TIMESTAMP_NTZ as a TIMESTAMP instant read in UTC, whatever the session
    time zone (watermarks need TIMESTAMP; windows then align to wall-clock midnight)."""
    return F.from_utc_timestamp(c.cast("timestamp"), session_tz)


def instant_to_wall(c: Column, session_tz: str, fmt: str = "yyyy-MM-dd") -> Column:
    """Render an instant produced by ``wall_to_instant`` back as wall-clock text."""
    return F.date_format(F.to_utc_timestamp(c, session_tz), fmt)


MEASURES = ["temperatura_promedio_c", "precipitacion_diaria_mm", "humedad_relativa_pct", "brillo_solar_horas"]


def _landed(spark: SparkSession, schema, source_dir: str, file_glob: str, max_files: int | None) -> DataFrame:
    """The landed files as a stream.  Without ``max_files`` a bounded replay takes them all in
    one batch, so the watermark cannot overtake files that are not in time order; a cap is only
    for files that land in time order."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    return (raw.option("maxFilesPerTrigger", max_files) if max_files else raw).parquet(source_dir)


def _base(spark: SparkSession, name: str, run_id: str | None) -> str:
    """Folder of a stream's table and checkpoint.  The same ``run_id`` finds them again, so a
    restarted query resumes; without one every run is new."""
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{run_id or uuid.uuid4().hex[:10]}")


def _finish(q, name: str) -> None:
    """Wait for the query, and fail if the watermark dropped rows: they would be missing from
    the result without an error."""
    q.awaitTermination()
    dropped = sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in q.recentProgress
                  for s in json.loads(p.json if isinstance(getattr(p, "json", None), str) else json.dumps(p)).get("stateOperators", []))
    if dropped:
        raise RuntimeError(f"{name}: {dropped} rows came later than the watermark allows; replay files in time order or without a cap")


def station_stream(spark: SparkSession, source_dir: str, file_glob: str = "events.parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming station readings from parquet files (schema taken from the landed files)."""
    schema = spark.read.parquet(os.path.join(source_dir, file_glob)).schema
    raw = _landed(spark, schema, source_dir, file_glob, max_files_per_trigger)
    eid, v = F.col("event_id"), F.col("value")

    def gap(k: int, val: Column) -> Column:
        return F.when(eid % k == 0, F.lit(None).cast("double")).otherwise(val)
    return raw.select(
        F.concat(F.lit("D"), (F.col("user_id") % 5).cast("string")).alias("departamento"),
        F.concat(F.lit("M"), F.col("user_id").cast("string")).alias("municipio"),
        wall_to_instant(F.col("ts"), spark.conf.get("spark.sql.session.timeZone")).alias("ts"),
        gap(7, 10 + v / 20).alias(MEASURES[0]), gap(5, v / 10).alias(MEASURES[1]),
        gap(11, 60 + v / 25).alias(MEASURES[2]), gap(3, v / 50).alias(MEASURES[3]))


def daily_rollup(readings: DataFrame, watermark: str = "2 days") -> DataFrame:
    """1-day tumbling windows per place with the A1 measures."""
    return (readings.withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 day"), "departamento", "municipio")
            .agg(F.avg(MEASURES[0]).alias("temp_media_c"),
                 F.coalesce(F.sum(MEASURES[1]), F.lit(0.0)).alias("precipitacion_mm"),
                 F.avg(MEASURES[2]).alias("humedad_media_pct"),
                 F.coalesce(F.sum(MEASURES[3]), F.lit(0.0)).alias("brillo_solar_horas")))


def price_windows(prices: DataFrame, date_col: str = "fecha", crop: str = "cultivo",
                  price: str = "precio_kg_promedio_cop", length: str = "28 days", slide: str = "7 days") -> DataFrame:
    """Mean price per crop over sliding windows (batch or streaming input)."""
    tz = prices.sparkSession.conf.get("spark.sql.session.timeZone")
    return (prices.groupBy(F.window(wall_to_instant(F.col(date_col), tz), length, slide), crop)
            .agg(F.avg(price).alias("moving_avg_price"), F.count(F.lit(1)).alias("n_prices")))


def run_available_now(df: DataFrame, name: str, mode: str = "append", run_id: str | None = None) -> DataFrame:
    """Run a streaming DataFrame over everything available, into parquet under the shared
    checkpoint folder, and return the written table (batch DataFrame)."""
    spark = df.sparkSession
    base = _base(spark, name, run_id)
    out, ckpt = os.path.join(base, "data"), os.path.join(base, "_checkpoint")
    q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start(out))
    _finish(q, name)
    return spark.read.parquet(out)


def price_stream(spark: SparkSession, source_dir: str, part: DataFrame, crops: list[str],
                 file_glob: str = "lineitem.parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming market prices: arriving line files joined to the static part table
    (stream-static join; the static side is a dimension) -> (ts, crop, price)."""
    schema = spark.read.parquet(os.path.join(source_dir, file_glob)).schema
    raw = _landed(spark, schema, source_dir, file_glob, max_files_per_trigger)
    tz = spark.conf.get("spark.sql.session.timeZone")
    crop = None
    for i, c in enumerate(crops):
        crop = F.when(F.col("p_partkey") % len(crops) == i, c) if crop is None else crop.when(
            F.col("p_partkey") % len(crops) == i, c)
    j = raw.join(part.select("p_partkey"), raw.l_partkey == F.col("p_partkey"))
    return j.where(F.col("l_shipdate").isNotNull() & (F.col("l_quantity") > 0)).select(
        wall_to_instant(F.col("l_shipdate"), tz).alias("ts"), crop.alias("cultivo"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("precio_kg_promedio_cop"))


def price_window_stream(prices: DataFrame, watermark: str = "14 days") -> DataFrame:
    """X2 streaming: sliding 28-day windows every 7 days per crop, emitted once closed."""
    return (prices.withWatermark("ts", watermark)
            .groupBy(F.window("ts", "28 days", "7 days"), "cultivo")
            .agg(F.avg("precio_kg_promedio_cop").alias("moving_avg_price"), F.count(F.lit(1)).alias("n_prices")))


def run_complete(df: DataFrame, name: str, run_id: str | None = None) -> DataFrame:
    """Run a streaming aggregate in ``complete`` mode over everything available.  Each
    micro-batch overwrites the result table (``foreachBatch``), so the table always holds
    the full current result.  Complete mode keeps every group in state: use it for bounded
    key spaces; append mode with a watermark is the unbounded, scalable form."""
    spark = df.sparkSession
    base = _base(spark, name, run_id)
    out, ckpt = os.path.join(base, "data"), os.path.join(base, "_checkpoint")

    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)
    q = (df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    _finish(q, name)
    return spark.read.parquet(out)
