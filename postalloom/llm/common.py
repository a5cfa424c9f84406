"""What several operators share: the contracts' characters, table access, cuts of lineage and joins that survive hot keys."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postalloom.operators.skew import HOT_KEYS, join_hot
from postalloom.plans.lineage import cut

__all__ = ["HOT_KEYS", "SPACES", "UPPER", "cut", "give_back", "join_hot", "row", "table", "to_python"]

#: The six characters that count as white space in every contract of this package.
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch of whole texts on its way to Python.
BATCH_BYTES = 4 << 20


def to_python(texts: DataFrame) -> DataFrame:
    """``texts``, with the session's Arrow batches bounded by BATCH_BYTES: the default, 16 times as much, is too large for texts beside a small heap."""
    conf, name = texts.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(name)).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return texts


def give_back() -> None:
    """Returns freed memory to the system: workers live on beside the next stages' heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def row(df: DataFrame, *without: str) -> Column:
    """All columns of ``df`` as one struct, so that their names cannot clash with an operator's own; ``select("row.*")`` unpacks it.

    A field that is always there keeps the struct valid where no column is left.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return F.struct(*kept or [F.lit(True).alias("_present")]).alias("row")
