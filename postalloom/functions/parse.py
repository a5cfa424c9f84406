"""Parsers of administrative parts: a grammar of unit suffixes, and a gazetteer joined as a table."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMMAR = (
    r"^(?:(?<province>[^省]{1,8}省|[^区]{1,8}自治区|(?:北京|上海|天津|重庆)市))?"
    r"(?:(?<city>[^市]{1,10}市|[^州]{1,12}州))?"
    r"(?:(?<district>[^区县旗]{1,10}(?:区|县|旗)))?(?<detail>.*)$"
)
NO_FIELDS = "struct(cast(null as string) as province, cast(null as string) as city, cast(null as string) as district, cast(null as string) as detail)"


class AdminParser(Protocol):
    def parse(self, df: DataFrame, column: str, first: str, second: str) -> DataFrame:
        """``df`` with two structs (province, city, district, detail), the second one as a fallback."""


def by_suffix(text: Column) -> Column:
    """Struct (province, city, district, detail) by the suffixes of the units; empty strings where a unit is missing."""
    parts = [F.coalesce(F.regexp_extract(text, GRAMMAR, i), F.lit("")).alias(name) for i, name in enumerate(("province", "city", "district", "detail"), 1)]
    return F.struct(*parts)


class SuffixParser:
    """Knows no places, only the characters that end their names."""

    def parse(self, df: DataFrame, column: str, first: str, second: str) -> DataFrame:
        return df.withColumn(first, by_suffix(F.col(column))).withColumn(second, F.expr(NO_FIELDS))


class GazetteerParser:
    """Places from a table (name, province, city, district); the longest name that starts the text wins, the grammar is the fallback.

    Candidates are found by an equi-join on each prefix length that occurs among the names, so any gazetteer size is fine.
    """

    def __init__(self, gazetteer: DataFrame):
        self.gazetteer = gazetteer.select("name", "province", "city", "district").where("name <> ''").dropDuplicates(["name"])

    def parse(self, df: DataFrame, column: str, first: str, second: str) -> DataFrame:
        sizes = [r[0] for r in self.gazetteer.select(F.char_length("name")).distinct().collect()]
        texts = df.select(F.col(column).alias("_text")).where("_text is not null").distinct()
        prefixes = texts.select("_text", F.explode(F.array(*[F.substring("_text", 1, n) for n in sorted(sizes)] or [F.lit("")])).alias("name")).distinct()
        hits = prefixes.join(self.gazetteer, "name")
        best = hits.groupBy("_text").agg(F.max_by(F.struct("name", "province", "city", "district"), F.char_length("name")).alias("_hit"))
        rest = F.expr(f"substring(`{column}`, char_length(_hit.name) + 1)")
        found = F.when(F.col("_hit").isNotNull(), F.struct("_hit.province", "_hit.city", "_hit.district", rest.alias("detail")))
        joined = df.join(best, F.col(column) == F.col("_text"), "left")
        return joined.withColumn(first, F.coalesce(found, F.expr(NO_FIELDS))).withColumn(second, by_suffix(F.col(column))).drop("_text", "_hit")
