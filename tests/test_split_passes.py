"""The split's passes read two written columns, not the catalog's plan."""

import re

from pyspark.sql import functions as F

from agrolattice.plans import models


def test_split_reads_its_rows_once(spark, tmp_path):
    spark.range(300).select(F.col("id").cast("string").alias("UID"), (F.col("id") % 3 == 0).alias("es_viable")).write.parquet(str(tmp_path / "cat"))
    cat = spark.read.parquet(str(tmp_path / "cat")).groupBy("UID").agg(F.first("es_viable").alias("es_viable"))
    out = models.split_catalog(cat)
    assert out.count() == 300
    # the cuts and the parts read the written columns: none of their plans goes back to the catalog
    assert out.inputFiles() and not any(re.search(r"/cat/", f) for f in out.inputFiles())
