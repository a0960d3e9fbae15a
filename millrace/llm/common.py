"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.staging import new_path


def stage(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write ``df`` as Parquet to the cluster's shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame, **kinds: str) -> list[Column]:
    """The named columns with their kinds; further columns of ``df`` are left behind."""
    return [F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()]
