"""Helpers that several operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that reach a Python worker at once, where the session sets none: a count of rows alone does not bound long texts.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Has texts travel to Python workers in batches of BATCH_BYTES; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Makes sure that checkpoint() has a folder: the one that spark.checkpoint.dir names. Without it, a local master (tests) gets one of this machine; a cluster is an error."""
    context = bounded(spark).sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return spark


def materialise(df: DataFrame) -> DataFrame:
    """Writes df once as a table in the shared checkpoint folder; later jobs, and lost executors, read it from there."""
    spark = ready(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def set_aside(df: DataFrame, *added: str) -> DataFrame:
    """df whose columns with the name of an added one are called in_<name>, so that both come out."""
    taken, names = {c.lower() for c in df.columns}, []
    for c in df.columns:
        name = c
        if c.lower() in added:
            while name.lower() in taken or name.lower() in added:
                name = f"in_{name}"
            taken.add(name.lower())
        names.append(name)
    return df.toDF(*names)


def listed(values) -> pd.Series:
    """A column of Python values; also right where there are none."""
    return pd.Series(list(values), dtype=object)


#: Bytes of a text that are split at once: a very long text never is one list of words.
PIECE_BYTES = 1 << 20


def pieces(data: bytes, gap: re.Pattern[bytes]) -> Iterator[bytes]:
    """data in pieces of some PIECE_BYTES, cut where gap (one byte that no word holds) matches."""
    lo = 0
    while lo < len(data):
        cut = gap.search(data, lo + PIECE_BYTES)
        hi = cut.start() if cut else len(data)
        yield data[lo:hi] if lo or cut else data
        lo = hi


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, m: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % m
