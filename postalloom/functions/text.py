"""Normalisation of address text as column expressions; Arrow UDFs only for Unicode normalisation and numerals."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postalloom.config import EngineConfig

# Replacements in the order in which they apply.
CORRECTIONS = (
    ("卅", "三十"), ("廿", "二十"), ("卌", "四十"),
    ("佰", "百"), ("仟", "千"), ("萬", "万"),
    ("衖", "巷"), ("裏", "里"), ("邨", "村"), ("廈", "厦"),
    ("傢俱", "家具"), ("傢具", "家具"),
    ("技园", "科技园"), ("枝术", "技术"), ("科枝", "科技"),
    ("工司", "公司"), ("分司", "分公司"), ("公局", "局"),
    ("广洲", "广州"), ("深训", "深圳"), ("汗京", "南京"),
    ("抗州", "杭州"), ("无夕", "无锡"),
    ("做坊", "作坊"), ("坊间", "坊"), ("幢幢", "幢"),
)
ROAD_FORMS = (
    ("大街", "街"), ("大道", "道"), ("大路", "路"),
    ("胡同", "巷"), ("弄堂", "弄"), ("里弄", "弄"),
    ("avenue", "大道"), ("road", "路"), ("street", "街"),
)
BUILDING_FORMS = (
    ("大楼", "大厦"), ("商务楼", "大厦"), ("写字楼", "大厦"),
    ("商厦", "大厦"), ("中心大楼", "中心"), ("大楼中心", "中心"),
    ("公寓楼", "公寓"), ("住宅楼", "住宅"), ("办公楼", "办公"),
)
DROPPED_UNITS = ("省", "市", "区", "县", "镇", "乡", "村", "街道", "办事处", "社区", "居委会")
ESTATE_WORDS = ("小区", "花园", "新村", "公寓", "别墅", "山庄", "园区", "科技园")
COMPONENT_PATTERNS = {
    "road": r"(.+?[路街大道巷弄胡同])",
    "number": r"(\d+[号\-]\d+|\d+)",
    "building": r"(\d+[号栋幢座]|\d+号楼|\d+栋楼)",
    "room": r"(\d+[室房号]|\d+单元|\d+-?\d+)",
    "floor": r"([地下]?\d+层|[BGF]\d+)",
}
STREET_PATTERN = r"(.+?[路街大道巷弄])"
NUMERALS = "一二三四五六七八九"
# End of the fixed values.

PARSED_FIELDS = ("province", "city", "district", "street", "detail", "full")
COMPONENT_FIELDS = ("road", "number", "building", "room", "floor", "estate")


def replace_all(text: Column, pairs) -> Column:
    """Literal replacements one after the other, so earlier ones feed later ones."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


@F.pandas_udf(T.StringType())
def printable_nfkc(texts: pd.Series) -> pd.Series:
    """Drops non-printable characters, then NFKC. Spark has no built-in for either."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", "".join(filter(str.isprintable, t))))


def basic_clean(text: Column) -> Column:
    """Printable, NFKC, lower-case, single spaces; then anything but words, CJK and some punctuation becomes a space."""
    tidy = F.btrim(F.regexp_replace(F.lower(printable_nfkc(text)), r"(?U)\s+", " "))
    return F.regexp_replace(tidy, r"(?U)[^\w一-鿿\-.,#()（）、，。；：]", " ")


def _numeral(run: str) -> str:
    """Digits of a run of one to three numerals; runs that are no number below 100 stay as they are, but for single ones."""
    digit = lambda c: str(NUMERALS.index(c) + 1)
    if run == "十":
        return ""
    if len(run) == 1:
        return digit(run)
    if len(run) == 2 and run[0] == "十":
        return "10" if run[1] == "十" else "1" + digit(run[1])
    if len(run) == 2 and run[1] == "十":
        return digit(run[0]) + "0"
    return run


def _clean_numeral(run: str) -> str:
    """As a reader would: 十 is ten, 二十三 is 23, 五一 stays."""
    if len(run) == 1:
        return "10" if run == "十" else str(NUMERALS.index(run) + 1)
    shape = re.fullmatch(f"([{NUMERALS}]?)十([{NUMERALS}]?)", run)
    if shape is None:
        return run
    tens = NUMERALS.index(shape[1]) + 1 if shape[1] else 1
    return str(10 * tens + (NUMERALS.index(shape[2]) + 1 if shape[2] else 0))


FAITHFUL_RUN = re.compile(f"([{NUMERALS}十]{{1,3}})[^万亿百千]")
CLEAN_RUN = re.compile(f"(?<![{NUMERALS}十百千万亿])([{NUMERALS}十]{{1,3}})(?![{NUMERALS}十百千万亿])")


def arabic_numerals(text: Column, faithful: bool = False) -> Column:
    """Chinese numerals below 100 as digits. Faithful: the character after the numeral is consumed with it."""
    pattern, convert = (FAITHFUL_RUN, _numeral) if faithful else (CLEAN_RUN, _clean_numeral)

    @F.pandas_udf(T.StringType())
    def converted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pattern.sub(lambda m: convert(m[1]), t))

    return converted(text)


def correct_errors(text: Column, faithful: bool = False) -> Column:
    """The CORRECTIONS, then numerals. Clean mode leaves a correct 科技园 alone."""
    if faithful:
        return arabic_numerals(replace_all(text, CORRECTIONS), True)
    held = F.replace(text, F.lit("科技园"), F.lit("\x01"))
    return arabic_numerals(F.replace(replace_all(held, CORRECTIONS), F.lit("\x01"), F.lit("科技园")))


def first_filled(*options: Column) -> Column:
    """The first option that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def merged_fields(first: Column, second: Column, full: Column) -> Column:
    """One struct of PARSED_FIELDS from two parsers' structs (province, city, district, detail).

    ``first`` is asked first for province, city and detail, ``second`` for the district; the street is the first match of
    its pattern in the detail, and every occurrence of it leaves the detail.
    """
    detail = first_filled(first["detail"], second["detail"])
    street = F.regexp_extract(detail, STREET_PATTERN, 1)
    rest = F.when(street == "", detail).otherwise(F.btrim(F.replace(detail, street, F.lit(""))))
    return F.struct(
        first_filled(first["province"], second["province"]).alias("province"), first_filled(first["city"], second["city"]).alias("city"),
        first_filled(second["district"], first["district"]).alias("district"), street.alias("street"), rest.alias("detail"), full.alias("full"),
    )


def standard_format(parsed: Column, faithful: bool = False) -> Column:
    """All parts joined, in standard forms and without the names of administrative units. Clean mode applies longer forms first."""
    order = (lambda pairs: pairs) if faithful else (lambda pairs: sorted(pairs, key=lambda p: -len(p[0])))
    joined = F.concat(*[parsed[c] for c in PARSED_FIELDS[:5]])
    units = DROPPED_UNITS if faithful else sorted(DROPPED_UNITS, key=len, reverse=True)
    formed = replace_all(replace_all(joined, order(ROAD_FORMS)), order(BUILDING_FORMS))
    return F.btrim(replace_all(formed, [(u, "") for u in units]))


def estate(text: Column) -> Column:
    """Around the first of ESTATE_WORDS, in their order, that occurs: ten characters before it to five after it."""
    found = F.lit("")
    for word in reversed(ESTATE_WORDS):
        at = F.instr(text, word)
        start = F.greatest(at - 10, F.lit(1))
        found = F.when(at > 0, F.btrim(F.substring(text, start, at + len(word) + 5 - start))).otherwise(found)
    return found


def components(text: Column) -> Column:
    """Struct of COMPONENT_FIELDS: the first match of each pattern, empty without one."""
    matches = [F.regexp_extract(text, COMPONENT_PATTERNS[c], 1).alias(c) for c in COMPONENT_FIELDS[:5]]
    return F.struct(*matches, estate(text).alias("estate"))


def short_hash(text: Column) -> Column:
    return F.when(text == "", F.lit("")).otherwise(F.substring(F.md5(text), 1, 12))


def normalized(df: DataFrame, column: str, parser, config: EngineConfig | None = None) -> DataFrame:
    """``df`` with original, cleaned, corrected, standardized, parsed, components, hash and success.

    Columns that ``df`` already has under these names are kept, and the new ones left out. Null and blank text gives
    empty strings, null structs and success false.
    """
    faithful = (config or EngineConfig()).faithful
    original = F.coalesce(F.col(column), F.lit(""))
    usable = F.length(F.btrim(F.regexp_replace(original, r"(?U)\s", " "))) > 0
    steps = df.withColumn("_original", original).withColumn("_cleaned", F.when(usable, basic_clean(F.col("_original"))).otherwise(F.col("_original")))
    steps = steps.withColumn("_corrected", F.when(usable, correct_errors(F.col("_cleaned"), faithful)).otherwise(F.col("_original")))
    steps = parser.parse(steps, "_corrected", "_first", "_second")
    steps = steps.withColumn("_parsed", F.when(usable, merged_fields(F.col("_first"), F.col("_second"), F.col("_corrected"))))
    steps = steps.withColumn("_standardized", F.when(usable, standard_format(F.col("_parsed"), faithful)).otherwise(F.col("_original")))
    made = {
        "original": F.col("_original"), "cleaned": F.col("_cleaned"), "corrected": F.col("_corrected"), "standardized": F.col("_standardized"),
        "parsed": F.col("_parsed"), "components": F.when(usable, components(F.col("_standardized"))), "hash": short_hash(F.col("_standardized")), "success": usable,
    }
    return steps.select(*[F.col(c) for c in df.columns], *[made[c].alias(c) for c in made if c not in df.columns])
