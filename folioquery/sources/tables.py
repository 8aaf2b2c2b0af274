"""Readers for the parquet tables a run is given, and stage tables it leaves."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from folioquery.session import ensure_checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the input folder; how it is split is the session's matter (spark.sql.files settings)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a table as a stream, whether the table is one file or a folder of part files.

    The bracket makes the path a pattern: a plain path would have to be a folder.
    """
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join of two tables that both grow with the input: the join shuffles them, whatever their files weigh.

    Left to itself Spark sends a side to the driver and to every task if its files are small. Stage
    tables repeat themselves and are small as files, with millions of rows.
    """
    return df.hint("merge")


def stage(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write a stage table to the shared checkpoint folder and read it back.

    Used where several later steps read one costly result: they then read only the
    columns they need, and a lost executor does not recompute the stage. With ``by`` rows lie in
    folders by these columns, and a read of some values opens their folders only.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
