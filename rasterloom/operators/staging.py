"""Tables between the rounds of an algorithm."""

from __future__ import annotations

import uuid

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share; a local one only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there.

    Plans know a table by the size of its files, which may be a hundredth of what its rows take, so joins with it are never broadcast.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def by_groups(rows: DataFrame, key: list[str], order: list[str], f: Callable[[pa.Table], Iterator[pa.Table]], schema: str, least: int = 1 << 17) -> DataFrame:
    """f over tables of many whole groups, sorted by key and then order; _n is a row's place in its group, from 1.

    As a grouped map, but Python is called once for some `least` rows instead of once a group, which for groups of a few hundred rows takes longer
    than the work. A task holds so many rows and one group more. Rows that lie together by a part of the key aren't shuffled.
    """

    def run(batches):
        held, n = [], 0
        for batch in batches:
            starts = np.flatnonzero(batch.column("_n").to_numpy() == 1)
            at = int(starts[-1]) if len(starts) else 0
            if len(starts) and n + at >= least:
                for found in f(pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks()):
                    yield from found.to_batches()
                batch, held, n = batch.slice(at), [], 0
            held.append(batch)
            n += batch.num_rows
        if n:
            for found in f(pa.Table.from_batches(held).combine_chunks()):
                yield from found.to_batches()

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).mapInArrow(run, schema)
