"""What the training-data operators share: table access and durable intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import remove, shared_folder

__all__ = ["ASCII_WORD", "beside", "documents", "durable", "holds", "named", "remove", "shared_folder", "shuffle_partitions", "spare", "split_join", "written"]

#: The white space that ends a word in every contract here: space and \t \n \v \f \r.
ASCII_WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare(columns: list[str], name: str) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that is none of ``columns`` (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def beside(df: DataFrame, result: Column, fields: list[str], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``df`` and the ``fields`` of the struct ``result``, computed once.

    A column of ``df`` with the name of a field gives way to it.
    """
    out = {f.lower() for f in fields}
    rest = [c for c in (df.columns if keep is None else keep) if c.lower() not in out]
    got = spare(df.columns, "_result")
    return df.select(*map(named, rest), result.alias(got)).select(*map(named, rest), *[F.col(f"{got}.{f}") for f in fields])


def split_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of ``left`` with ``right``, which was grouped by ``keys``, so that Spark may split a hot key of ``left``.

    Spark splits a partition only if both sides come straight from an exchange. A grouped side would
    be joined as it was grouped; a hash of the keys as one more key has it exchanged once more.
    """
    hashed = F.xxhash64(*map(named, keys))
    return left.withColumn("join_hash", hashed).join(right.withColumn("join_hash", hashed), [*keys, "join_hash"]).drop("join_hash")


#: What this worker remembers between batches, by owner, and how to forget it.
_held: dict[str, Callable[[], None]] = {}


def holds(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Says that ``owner`` is at work here, and how it forgets what it remembers; all others forget now.

    A worker lives on from stage to stage, and what one stage remembered is of no use to the next.
    """
    if forget is not None:
        _held[owner] = forget
    others = [x for x in _held if x != owner]
    for other in others:
        _held.pop(other)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        # what was freed stays with the C library's allocator otherwise
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def written(df: DataFrame) -> str:
    """The folder that ``df`` was written to as parquet, in the folder that all executors share; whoever asked removes it."""
    place = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return place


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
