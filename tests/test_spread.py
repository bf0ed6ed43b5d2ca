"""Planning work is dealt over the cores, however few splits the requests' file has."""

from pyspark.sql import functions as F

from agrolattice.params import CROPS
from agrolattice.plans.planner import sowing_plan
from agrolattice.session import spread


def test_plans_of_one_split_run_in_many_tasks(spark, tmp_path):
    (spark.range(2000).select(F.col("id").alias("parcel_id"), F.lit(CROPS[0]).alias("cultivo"), *[F.lit(v).cast("double").alias(c) for c, v in
                              {"ph_suelo": 6, "altitud_m": 1500, "pendiente_pct": 5, "temp_media_c": 20, "precipitacion_anual_mm": 1800}.items()],
                              F.lit("A").alias("departamento"), F.lit("x").alias("municipio"))
     .coalesce(1).write.parquet(str(tmp_path / "parcels")))
    parcels = spark.read.parquet(str(tmp_path / "parcels"))
    production = spark.createDataFrame([("A", "x", CROPS[0], 2.0)], "departamento string, municipio string, cultivo string, rendimiento_ton_ha double")
    climate = spark.createDataFrame([("A", "x", 20.0, 3.0)], "departamento string, municipio string, temperatura_promedio_c double, precipitacion_diaria_mm double").withColumn(
        "fecha", F.lit("2020-01-02").cast("timestamp"))
    plan = sowing_plan(spread(parcels), climate, production).select("parcel_id", "best_yield", F.spark_partition_id().alias("task"))
    rows = plan.collect()
    assert sorted(r["parcel_id"] for r in rows) == list(range(2000))
    assert len({r["task"] for r in rows}) >= min(4, spark.sparkContext.defaultParallelism)
