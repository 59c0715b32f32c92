"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process (tests, a laptop) a local one is made; on
    a cluster other machines would not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="linework-")
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; takes a third of a checkpoint's disk."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def give_back() -> None:
    """Ask the C library to return freed memory to the system, so that a worker that is used again starts small."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pa_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def arrow_rows(made: Iterator[tuple], names: list[str], keys: list[pa.DataType], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` rows from (keys of a text, its arrays of one length)."""
    held, rows = [], 0

    def out() -> pa.RecordBatch:
        sizes = [len(arrays[0]) for _, arrays in held]
        owner = pa.array(np.repeat(np.arange(len(held)), sizes))
        columns = [pa.array([k[i] for k, _ in held], kind).take(owner) for i, kind in enumerate(keys)]
        columns += [pa.array(np.concatenate([arrays[i] for _, arrays in held])) for i in range(len(held[0][1]))]
        return pa.RecordBatch.from_arrays(columns, names)

    for own in made:
        held.append(own)
        rows += len(own[1][0])
        if rows >= most:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Array of words; empty for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id is fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0))
