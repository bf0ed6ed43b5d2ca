"""Materialise the processed tables and persist models.

``run_pipeline`` builds master (E1), the yearly climate / price roll-ups, the livestock
table and the clean catalog (E2), writes each once as parquet and re-reads it, so later
jobs start from files (lineage cut, survives executor loss) instead of recomputing.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import yearly_prices
from ..session import source_stamp
from ..sources.tables import path_exists, regional_extracts, write_table
from . import catalog as catalog_plan
from . import master as master_plan
from .models import YieldModel


#: The inputs that each table is made from.
DEPENDS = {
    "clima_ideam_anual": ["climate"],
    "consolidated_data": ["production", "soils", "climate", "credit", "prices", "land", "livestock"],
    "precios_sipsa_anual": ["prices"],
    "inventario_ganadero_anual": ["livestock"],
    "cleaned_datasets_catalog": ["catalog_raw"],
}
_MANIFEST = "_manifest.json"


def run_pipeline(spark: SparkSession, out_dir: str, production: DataFrame, soils: DataFrame, climate: DataFrame,
                 credit: DataFrame, prices: DataFrame, land: DataFrame, livestock: DataFrame,
                 catalog_raw: DataFrame, climate_order: list[str] | None = None,
                 key_cols: tuple = ("anio",), reuse: bool = False,
                 target_rows: int = 1_000_000, version: str = "") -> dict[str, DataFrame]:
    """Write every processed table under ``out_dir`` and return them re-read.

    A table is written aside and takes its place by a rename, with a manifest of the state of the
    files behind its inputs (``input_stamp``), the parameters and ``version``.  With ``reuse=True``
    a table whose manifest says the same is read as it is: a changed source rebuilds only what
    depends on it, and what a broken write left is never read.  Inputs that are not read from files
    have no stamp, and their tables are always built.  Give a new ``version`` when the way that
    the inputs are derived from their files changes.
    """
    inputs = {"production": production, "soils": soils, "climate": climate, "credit": credit, "prices": prices,
              "land": land, "livestock": livestock, "catalog_raw": catalog_raw}
    stamps = {name: input_stamp(df) for name, df in inputs.items()}
    params = {"clima_ideam_anual": {"climate_order": climate_order},
              "consolidated_data": {"climate_order": climate_order, "key_cols": list(key_cols)}}
    result: dict[str, DataFrame] = {}
    build = {
        "clima_ideam_anual": lambda: master_plan.filled_yearly_climate(climate, climate_order, target_rows),
        "consolidated_data": lambda: master_plan.consolidate(
            production, soils, climate, credit, prices, land, livestock, climate_order=climate_order, key_cols=key_cols,
            target_rows=target_rows, yearly_climate=result["clima_ideam_anual"]),
        "precios_sipsa_anual": lambda: yearly_prices(prices),
        "inventario_ganadero_anual": lambda: livestock,
        "cleaned_datasets_catalog": lambda: catalog_plan.clean_catalog(catalog_raw),
    }
    for name, make in build.items():
        wanted = {"inputs": {i: stamps[i] for i in DEPENDS[name]}, "params": params.get(name, {}), "version": version}
        path = os.path.join(out_dir, name)
        known = all(wanted["inputs"].values())
        if not (reuse and known and read_manifest(spark, path) == wanted):
            publish(make(), path, wanted)
        result[name] = spark.read.parquet(path)
    return result


def input_stamp(df: DataFrame) -> str | None:
    """Digest of the state of the folders that ``df`` reads (names, sizes and times of their
    files); None if it reads no files."""
    folders = sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    if not folders:
        return None
    return hashlib.md5("|".join(f"{p}={source_stamp(df.sparkSession, p)}" for p in folders).encode()).hexdigest()


def publish(df: DataFrame, path: str, manifest: dict) -> None:
    """Write ``df`` and its manifest beside ``path``, then put them in its place.  A failure before
    the end leaves the old table or none, never a part of the new one."""
    spark = df.sparkSession
    aside = os.path.join(os.path.dirname(path), f"_building-{os.path.basename(path)}-{uuid.uuid4().hex[:10]}")
    write_table(df, aside)
    fs, target = _fs(spark, path)
    out = fs.create(_fs(spark, os.path.join(aside, _MANIFEST))[1], True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    fs.delete(target, True)
    if not fs.rename(_fs(spark, aside)[1], target):
        raise OSError(f"could not publish {path}")


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a published table, or None."""
    if not path_exists(spark, os.path.join(path, _MANIFEST)):
        return None
    fs, jpath = _fs(spark, os.path.join(path, _MANIFEST))
    stream = fs.open(jpath)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _fs(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def extract_by_department(df: DataFrame, out_dir: str, dept_col: str) -> DataFrame:
    """One CSV extract per department in one job; returns rows per written extract."""
    regional_extracts(df, out_dir, dept_col)
    back = (df.sparkSession.read.option("header", True).option("multiLine", True).option("quote", '"')
            .option("escape", '"').csv(out_dir))
    return back.groupBy(F.col("_dept").alias("departamento")).agg(F.count(F.lit(1)).alias("rows"))


def save_model(spark, model: YieldModel, path: str) -> None:
    """Persist a fitted yield model (overwrite)."""
    model.save(spark, path)


def load_model(spark, path: str) -> YieldModel:
    return YieldModel.load(spark, path)
