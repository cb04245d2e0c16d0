"""Reading and publishing the ten stored tables."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.sources.schemas import TABLES


# Written last; a folder without it is not a whole snapshot.
MANIFEST = "_published"


def load_feedback(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Read the ten tables of a finished snapshot. A missing or mistyped column fails, none is inferred."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, MANIFEST), "_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        raise FileNotFoundError(f"{folder} has no finished snapshot")

    def load(name: str) -> DataFrame:
        path, schema = os.path.join(folder, name), TABLES[name]
        found = {f.name: f.dataType for f in spark.read.parquet(path).schema}
        if bad := [f.name for f in schema if found.get(f.name) != f.dataType]:
            raise ValueError(f"table {name}: columns missing or of another type: {', '.join(bad)}")
        return spark.read.schema(schema).parquet(path)

    # A look at a footer is a job of its own; the ten of them run side by side.
    with ThreadPoolExecutor(len(TABLES)) as pool:
        return dict(zip(TABLES, pool.map(load, TABLES), strict=True))


def save_feedback(tables: dict[str, DataFrame], folder: str) -> None:
    """Publish a snapshot to a new folder. An existing one is never overwritten: it may be being read.

    The tables are independent jobs and are submitted together, so that small ones fill the gaps of large.
    The manifest comes last, so a crash leaves a folder that does not load.
    """

    def save(name: str) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]
        tables[name].select(columns).write.mode("errorifexists").parquet(os.path.join(folder, name))

    with ThreadPoolExecutor(len(TABLES)) as pool:
        list(pool.map(save, TABLES))
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(name,) for name in TABLES], "value STRING").coalesce(1)
    names.write.mode("errorifexists").text(os.path.join(folder, MANIFEST))
