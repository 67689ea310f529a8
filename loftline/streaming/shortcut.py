"""Matching beside the last match, over a stream of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import shortcut
from ..session import stored


def match_stream(rows: DataFrame, refs: DataFrame, folder: str, window: int, least: float, every: int) -> DataStreamWriter:
    """A writer that matches each batch of a stream of queries as `shortcut.matches` does, from where the batch before ended.

    The matches of batch i go to folder/matches/batch=i and the last match of each track to folder/ends/batch=i, both as Parquet; folder
    is one that all executors share. A batch that is run again after a failure reads the ends of the batch before it and overwrites its
    own. Queries of a track come in order from batch to batch; then the matches are those of one batch of all of them.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        start = spark.read.parquet(f"{folder}/ends/batch={number - 1}") if number else None
        found = stored(shortcut.matches(batch, refs, window, least, every, start))
        found.write.mode("overwrite").parquet(f"{folder}/matches/batch={number}")
        shortcut.ends(found, start).write.mode("overwrite").parquet(f"{folder}/ends/batch={number}")

    return rows.writeStream.foreachBatch(run)
