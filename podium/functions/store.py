"""Intermediate tables in the shared folder: they cut the lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from podium.session import fresh_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a new table and read it back. Spark plans joins with it from its real size, and can split its
    hot keys, as it comes without a partitioning of its own."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by `stored` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for parent in {name.rpartition("/")[0] for name in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
