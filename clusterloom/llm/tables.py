"""Reading the tables that the registered queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clusterloom.plans.names import fresh as fresh  # names for columns of our own

#: White space as the operators here understand it: blank and the controls from tab to return.
BLANK = r"[\x20\x09-\x0D]+"
#: A word is a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
