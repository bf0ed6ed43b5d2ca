"""Scans and sinks.

Farm tables are CSV with declared schemas (never ``inferSchema``); an absent path gives an
empty DataFrame of the declared schema.  The dataset catalog is a set of CSV files whose
columns differ; they are read as all-string and unioned by name.
"""

from __future__ import annotations

import csv
import io
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import CATALOG_COLUMNS
from ..session import source_stamp

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


_READ_CACHE: dict = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, refresh: bool = False) -> DataFrame:
    """One parquet table of the driver's data set.

    The DataFrame (file listing + footer schema) is kept per session and path: a query that
    reads a table in several branches plans it once.  ``refresh=True`` re-lists the files."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    key = (spark.sparkContext.applicationId, path, source_stamp(spark, path))
    if refresh or key not in _READ_CACHE:
        _READ_CACHE[key] = spark.read.parquet(path)
    return _READ_CACHE[key]


def read_csv_table(spark: SparkSession, path: str, schema: "StructType | str") -> DataFrame:
    """Header CSV with a declared schema, by column name: columns may come in any order, a
    missing one is null, others are ignored, and a value that does not cast is null.  Missing
    file -> empty table of that schema."""
    empty = spark.createDataFrame([], schema)
    if not _exists(spark, path):
        return empty
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False)
           .option("multiLine", True).option("escape", '"').csv(path))
    raw = raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in raw.columns
                        else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields])


#: Column of a text row that does not fit its header.
BAD_RECORD = "_bad_record"


def read_catalog_files(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """S2 + U1: every catalog file as strings, unioned by column name (missing -> null).

    ``paths`` are files or folders of files.  Files with one header are one scan (see
    ``scan_catalog``); an empty or unreadable file is skipped.  The UTF-8 BOM is dropped.
    A row with too few or too many values keeps those that fit; ``catalog_quarantine`` lists it.
    """
    scans, _ = scan_catalog(spark, paths, multi_line)
    return _union(spark, [df.drop(BAD_RECORD, "_file") for df in scans])


def catalog_quarantine(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """file, problem, record: the files that could not be read or hold no header, and the rows
    that do not fit their file's header."""
    scans, skipped = scan_catalog(spark, paths, multi_line)
    out = spark.createDataFrame([(f, why, None) for f, why in skipped], "file string, problem string, record string")
    for df in scans:
        # the reader wants another of the file's columns beside the bad record: ask for one
        first = F.col(f"`{df.columns[0]}`")
        bad = df.where(F.col(BAD_RECORD).isNotNull() & (F.length(F.coalesce(first, F.lit(""))) >= 0))
        out = out.unionAll(bad.select("_file", F.lit("row does not fit the header"), BAD_RECORD))
    return out


def scan_catalog(spark: SparkSession, paths: list[str], multi_line: bool = True) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """One DataFrame for each distinct header among the files of ``paths``, and the files left out
    with the reason.  Only the headers are read here, a line a file, several files at a time.

    With ``multi_line`` a quoted value may hold line breaks, and a file is one task; without it
    files are split.  The columns ``_file`` and ``BAD_RECORD`` are added.
    """
    files, skipped = [], []
    for p in paths:
        try:
            files += _files_under(spark, p)
        except Exception as e:  # absent or unreadable: skipped like the original loader
            skipped.append((p, f"unreadable: {type(e).__name__}"))
    groups: dict[tuple, list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for f, header in zip(files, pool.map(lambda f: _header(spark, f), files)):
            if isinstance(header, str):
                skipped.append((f, header))
            else:
                groups.setdefault(tuple(header), []).append(f)
    scans = []
    for header, members in groups.items():
        schema = StructType([StructField(c, StringType()) for c in (*header, BAD_RECORD)])
        df = (spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"')
              .option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_RECORD).csv(members))
        scans.append(df.withColumn("_file", F.col("_metadata.file_path")))
    return scans, skipped


def _union(spark: SparkSession, frames: list[DataFrame]) -> DataFrame:
    if not frames:
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in CATALOG_COLUMNS]))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _files_under(spark: SparkSession, path: str) -> list[str]:
    """The file itself, or the data files of a folder, by name."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(jpath) if x.isFile()]
    return sorted(x.toString() for x in found if not x.getName().startswith(("_", ".")))


def _header(spark: SparkSession, path: str) -> list[str] | str:
    """Column names of a CSV file (a quoted one may hold line breaks), or why there are none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    try:
        jpath = jvm.org.apache.hadoop.fs.Path(path)
        stream = jpath.getFileSystem(conf).open(jpath)
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(jpath)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        try:
            text = reader.readLine()
            while text is not None and text.count('"') % 2:
                more = reader.readLine()
                if more is None:
                    break
                text += "\n" + more
        finally:
            reader.close()
    except Exception as e:  # a broken file must not end the job
        return f"unreadable: {type(e).__name__}"
    names = next(csv.reader(io.StringIO((text or "").lstrip("\ufeff"), newline="")), [])
    if not any(names):
        return "no header"
    # a nameless or repeated column is told by its place, as the CSV reader does
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def catalog_paths(spark: SparkSession, workspace_dir: str, prefix: str = "reto_") -> list[str]:
    """The catalog files of a folder on any Hadoop file system, by name."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(workspace_dir, f"{prefix}*.csv"))
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().toString() for x in fs.globStatus(jpath) or [])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Write a table; ``partition_by`` lays out one folder per key (e.g. department)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # RFC 4180 quoting ("" inside quotes), matching the reader below, so texts with quotes,
        # backslashes or line breaks survive the round trip
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def regional_extracts(df: DataFrame, path: str, dept_col: str) -> None:
    """One CSV extract per department, all written by a single job."""
    write_table(df.withColumn("_dept", F.coalesce(F.col(dept_col), F.lit("Nacional"))), path,
                fmt="csv", partition_by=["_dept"])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on the cluster file system (local, HDFS or object store)."""
    return _exists(spark, path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def write_partitioned(df: DataFrame, path: str, partition_col: str) -> None:
    """Lay a table out by ``partition_col`` (e.g. department) so region reads prune folders."""
    df.write.mode("overwrite").partitionBy(partition_col).parquet(path)


def read_region(spark: SparkSession, path: str, partition_col: str, value: str, columns: list[str]) -> DataFrame:
    """S3: region-filtered, column-pruned scan.  The filter on the partition column prunes
    folders (PartitionFilters) and only ``columns`` are read (ReadSchema)."""
    return spark.read.parquet(path).where(F.col(partition_col) == value).select(*columns)
