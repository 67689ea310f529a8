"""What several operators share: table access, checkpoints and counted words."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest number of rows that a side may have to be broadcast by an explicit hint.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that more than one in so many rows have are hot; there are fewer than so many of them.
HOT = 4096


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, a temporary one, if all of Spark is one machine's."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; executors need a folder that all of them share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return folder or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by an eager checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go as soon as the step that made them ends, not when the driver happens to collect its garbage.

    A frame that was made inside and is run twice shuffles again, so what is returned to a caller is made outside.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted to have no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(name: str, *columns: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_hot(rows: DataFrame, groups: DataFrame, key: str, count: str, values: list[str]) -> DataFrame:
    """rows, left-joined with the values that groups (checkpointed, one row for each key) has for its binary key.

    count says how many rows have the key. Hot keys, fewer than HOT by construction, are broadcast. The other
    keys meet by a shuffle in which none has more than one in HOT of the rows; rows that have no key or a hot one are
    dealt out evenly there, under 8 bytes of their own (real keys must have another length).
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    is_hot, found = F.col(count) * HOT > total, F.struct(*values)
    hot = groups.where(is_hot).select(F.col(key).alias("__key"), found.alias("__hot"))
    cold = groups.where(~is_hot).select(F.col(key).alias("__meet"), found.alias("__cold"))
    lone = F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    meet = F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(lone)
    near = rows.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left").withColumn("__meet", meet)
    value = F.coalesce("__hot", "__cold")
    return near.join(cold, "__meet", "left").select(*rows.columns, *(value[v].alias(v) for v in values))
