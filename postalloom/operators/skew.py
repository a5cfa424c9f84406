"""Joins that a hot key cannot make uneven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT_KEYS of all rows is always among the HOT_KEYS most frequent ones, so a
#: table of that many keys is all that has to be broadcast to take every hot key out of a shuffle.
HOT_KEYS = 1024


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, spread: list[str]) -> DataFrame:
    """Left outer equi-join that no key can make uneven.

    ``right`` has one row per key; its column ``weight`` says how many rows of ``left`` have the key. The
    HOT_KEYS heaviest keys are joined by a broadcast of exactly that many rows; the rows they match leave
    the shuffled join under spread-out keys that match nothing. Each remaining key holds at most
    1/HOT_KEYS of the rows. Null keys match each other. ``spread`` names columns of ``left`` that tell
    rows of one key apart.
    """
    values = [c for c in right.columns if c not in keys]
    packed = F.struct(*values) if values else F.struct(F.lit(True).alias("_present"))

    def named(side: DataFrame, tag: str) -> DataFrame:
        return side.select(*[F.col(k).alias(f"_{tag}{i}") for i, k in enumerate(keys)], packed.alias(f"_{tag}"))

    def same(tag: str) -> Column:
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_{tag}{i}"))
        return on

    hot = named(right.orderBy(F.desc(weight), *keys).limit(HOT_KEYS), "hot")
    first = left.join(F.broadcast(hot), same("hot"), "left").drop(*[f"_hot{i}" for i in range(len(keys))])
    away = F.xxhash64(*spread).bitwiseOR(F.lit(1))
    first = first.withColumn("_away", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(away))
    cold = named(right, "cold").withColumn("_home", F.lit(0).cast("long"))
    second = first.join(cold, same("cold") & (F.col("_away") == F.col("_home")), "left")
    return second.select(
        *[F.col(c) for c in left.columns],
        *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in values],
    )
