"""Live readings adjust the predictions, and late rows are kept.

A feed's state is a table of sums and counts by day and place, one folder a micro-batch.  Sums
and counts merge in any order, so rows may come as late as they like, and a batch that runs
again after a failure overwrites its own folder: every row counts once.  A micro-batch costs one
partial aggregate of its own rows, whatever the age of the feed.

A row is late if its day had closed (its end lies at or before the newest reading of all earlier
batches less ``delay``) when it came.  Late rows are also written to a table of their own.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calibration import calibration_of_sums, request_level
from ..sources.tables import path_exists
from .rollups import MEASURES, _base

PLACE = ["departamento", "municipio"]
_TEMP, _RAIN, _HUM, _SUN = MEASURES


class ClimateFeed:
    """Readings (PLACE, ``ts``, MEASURES) from a stream, folded into day sums.

    ``ts`` is a wall-clock time read in UTC (``rollups.wall_to_instant``), whatever the session's zone.

    With the same ``run_id`` a feed finds its tables and checkpoint again.  Readings without a
    time or a place count nowhere, as in the batch roll-up.
    """

    def __init__(self, spark: SparkSession, name: str, run_id: str | None = None, delay: str = "2 days"):
        self.spark, self.delay = spark, delay
        self.base = _base(spark, name, run_id)

    def _path(self, table: str) -> str:
        return os.path.join(self.base, table)

    def _put(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(self._path(table), f"batch_id={batch_id}"))

    def _get(self, table: str, schema: str, upto: int | None = None) -> DataFrame:
        """The rows of all batches (up to ``upto``), with their batch_id; none yet: an empty table."""
        if not path_exists(self.spark, self._path(table)):
            return self.spark.createDataFrame([], f"{schema}, batch_id bigint")
        df = self.spark.read.schema(f"{schema}, batch_id bigint").parquet(self._path(table))
        return df if upto is None else df.where(F.col("batch_id") <= upto)

    # ------------------------------------------------------------------ state
    def day_sums(self, upto: int | None = None) -> DataFrame:
        """day, place, late, sums and counts: the parts of every batch, not yet added up."""
        return self._get("days", "day timestamp, departamento string, municipio string, late boolean, temp_sum double, "
                         "temp_n bigint, rain_sum double, hum_sum double, hum_n bigint, sun_sum double, n bigint", upto)

    def late_rows(self) -> DataFrame:
        """The late rows as they came."""
        return self._get("late", "departamento string, municipio string, ts timestamp, "
                         + ", ".join(f"{m} double" for m in MEASURES))

    def _newest(self, before: int | None = None) -> DataFrame:
        marks = self._get("marks", "newest timestamp", None if before is None else before - 1)
        return marks.agg((F.max("newest") - F.expr(f"interval {self.delay}")).alias("mark"))

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        """Fold one micro-batch in; may run again."""
        mark = self._newest(before=batch_id).first()["mark"]
        rows = batch.where("ts is not null and departamento is not null and municipio is not null")
        rows = rows.withColumn("day", F.window("ts", "1 day")["start"])
        rows = rows.withColumn("late", F.coalesce(F.col("day") + F.expr("interval 1 day") <= F.lit(mark), F.lit(False)))
        rows = rows.persist()
        try:
            self._put(rows.where("late").select(*PLACE, "ts", *MEASURES), "late", batch_id)
            self._put(rows.groupBy("day", *PLACE, "late").agg(
                F.sum(_TEMP).alias("temp_sum"), F.count(_TEMP).alias("temp_n"), F.sum(_RAIN).alias("rain_sum"),
                F.sum(_HUM).alias("hum_sum"), F.count(_HUM).alias("hum_n"), F.sum(_SUN).alias("sun_sum"),
                F.count(F.lit(1)).alias("n")), "days", batch_id)
            self._put(rows.agg(F.max("ts").alias("newest")), "marks", batch_id)
        finally:
            rows.unpersist()

    def run(self, readings: DataFrame, then: Callable[[int], None] | None = None) -> "ClimateFeed":
        """Take in all that has landed; ``then(batch_id)`` runs after each micro-batch is folded in
        (such as ``Predictions.update``) and again if that batch runs again."""
        def step(batch: DataFrame, batch_id: int) -> None:
            self.absorb(batch, batch_id)
            if then:
                then(batch_id)
        (readings.writeStream.foreachBatch(step).option("checkpointLocation", self._path("_checkpoint"))
         .trigger(availableNow=True).start().awaitTermination())
        return self

    # ------------------------------------------------------------------ results
    def closed_days(self, repaired: bool = True) -> DataFrame:
        """The A1 measures of each closed day and place; with ``repaired`` the late rows are merged
        in, without it the rows are those that had come when the day closed."""
        parts = self.day_sums()
        parts = (parts if repaired else parts.where("not late")).crossJoin(F.broadcast(self._newest()))  # one row
        parts = parts.where(F.col("day") + F.expr("interval 1 day") <= F.col("mark"))
        return parts.groupBy("day", *PLACE).agg(
            F.try_divide(F.sum("temp_sum"), F.sum("temp_n")).alias("temp_media_c"),
            F.coalesce(F.sum("rain_sum"), F.lit(0.0)).alias("precipitacion_mm"),
            F.try_divide(F.sum("hum_sum"), F.sum("hum_n")).alias("humedad_media_pct"),
            F.coalesce(F.sum("sun_sum"), F.lit(0.0)).alias("brillo_solar_horas"))

    def calibration(self, upto: int | None = None) -> DataFrame:
        """The planner's climate calibration (A27) from all readings so far."""
        tz = self.spark.conf.get("spark.sql.session.timeZone")
        sums = (self.day_sums(upto).groupBy(F.month(F.to_utc_timestamp("day", tz)).alias("mes"), *PLACE)
                .agg(*[F.sum(c).alias(c) for c in ("rain_sum", "temp_sum", "temp_n")]))
        return calibration_of_sums(sums)


class Predictions:
    """A table of predictions that follows a feed.

    ``score(requests, calibration)`` is a batch job such as the sowing planner; ``columns`` of its
    result are kept.  After each micro-batch only the requests whose calibration it changed are
    scored again: those of a municipality or a department with new readings, and the national ones.
    """

    def __init__(self, feed: ClimateFeed, requests: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame],
                 key: str, columns: list[str]):
        self.feed, self.requests, self.score, self.key, self.columns = feed, requests, score, key, columns

    def start(self) -> "Predictions":
        """Score every request without readings; a feed that is started again keeps its table."""
        if not path_exists(self.feed.spark, os.path.join(self.feed._path("predictions"), "batch_id=-1", "_SUCCESS")):
            self._store(self.requests, -1)
        return self

    def _store(self, requests: DataFrame, batch_id: int) -> None:
        out = self.score(requests, self.feed.calibration(upto=batch_id))
        self.feed._put(out.select(self.key, *self.columns), "predictions", batch_id)

    def touched(self, batch_id: int) -> DataFrame:
        """The requests whose calibration the batch changed."""
        new = self.feed.day_sums().where(F.col("batch_id") == batch_id)
        new = new.select(F.lower("departamento").alias("_d"), F.lower("municipio").alias("_m"))
        # a row for each level that holds new readings, keyed as a request names it
        levels = new.groupingSets([["_d", "_m"], ["_d"], []], "_d", "_m").agg(
            F.grouping_id("_d", "_m").cast("int").alias("_l"), F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")
        level, d, m = request_level(F.col("departamento"), F.col("municipio"))
        return self.requests.join(levels, (level == F.col("_l")) & d.eqNullSafe(F.col("_d")) & m.eqNullSafe(F.col("_m")), "left_semi")

    def update(self, batch_id: int) -> None:
        self._store(self.touched(batch_id), batch_id)

    def latest(self) -> DataFrame:
        """Each request's newest prediction, and the batch it comes from."""
        path = self.feed._path("predictions")
        rows = self.feed.spark.read.option("basePath", path).parquet(path)
        newest = F.max_by(F.struct(*self.columns, "batch_id"), "batch_id").alias("_p")
        return rows.groupBy(self.key).agg(newest).select(self.key, "_p.*")
