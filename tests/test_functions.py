import math

import pytest
from pyspark.sql import functions as F

from postalloom.config import EngineConfig
from postalloom.functions import geo, parse, similarity, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("source", "faithful", "clean"),
    [
        ("三号楼", "3楼", "3号楼"), ("十一号", "11", "11号"), ("十一", "", "11"), ("二十三号", "二十三", "23号"), ("五一路", "五一", "五一路"), ("二十号", "20", "20号"), ("三", "三", "3"),
        ("八一大道", "八一道", "八一大道"), ("三百号", "三百号", "三百号"), ("中山一路", "中山1", "中山1路"), (None, None, None),
    ],
)
def test_numerals(spark, source, faithful, clean):
    row = spark.createDataFrame([(source,)], "t string").select(text.arabic_numerals(F.col("t"), True).alias("f"), text.arabic_numerals(F.col("t")).alias("c")).first()
    assert (row["f"], row["c"]) == (faithful, clean)


def test_clean_and_corrections(spark):
    assert one(spark, text.basic_clean(F.col("t")), t="ＡＢ　Ｃ：（1）é\t!") == "abc (1)é "
    assert one(spark, text.correct_errors(F.col("t"), True), t="科技园") == "科科技园"
    assert one(spark, text.correct_errors(F.col("t")), t="科技园 技园 深训") == "科技园 科技园 深圳"


def test_components(spark):
    row = spark.createDataFrame([("大同路12号楼b2地下2层",)], "t string").select(text.components(F.col("t")).alias("c")).first()["c"]
    assert (row["road"], row["building"], row["floor"]) == ("大同", "12号", "下2层")
    assert one(spark, text.estate(F.col("t")), t="abcdefghijklmno花园xyz1234567") == "fghijklmno花园xyz12"
    assert one(spark, text.estate(F.col("t")), t="none") == ""


def test_standard_format_modes(spark):
    parsed = F.struct(*[F.lit(x).alias(n) for n, x in zip(text.PARSED_FIELDS, ("浙江省", "杭州市", "西湖区", "", "中心大楼", ""), strict=True)])
    assert one(spark, text.standard_format(parsed, True), t="") == "浙江杭州西湖中心大厦"
    assert one(spark, text.standard_format(parsed), t="") == "浙江杭州西湖中心"


def test_normalized_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "  \t"), (3, "浙江省杭州市西湖区文三路20号"), (4, "")], "id long, a string").withColumn("hash", F.lit("mine"))
    rows = {r["id"]: r for r in text.normalized(df, "a", parse.SuffixParser()).collect()}
    assert [rows[i]["success"] for i in (1, 2, 3, 4)] == [False, False, True, False]
    assert rows[1]["standardized"] == "" and rows[1]["parsed"] is None and rows[3]["hash"] == "mine"
    assert rows[3]["parsed"]["street"] == "文三路" or rows[3]["parsed"]["street"].startswith("文")
    assert rows[3]["parsed"]["district"] == "西湖区"


def test_text_measures(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, similarity.edit_similarity(a, b), a="北京", b="上海") == 0.0
    assert one(spark, similarity.edit_similarity(a, b), a="kitten", b="sitting") == pytest.approx(1 - 3 / 7)
    assert one(spark, similarity.edit_similarity(a, b), a="", b="") == 0.0
    assert one(spark, similarity.jaro_winkler(a, b), a="martha", b="marhta") == pytest.approx(0.961111, abs=1e-6)
    assert one(spark, similarity.jaro_winkler(a, b), a="abcd", b="abxyzw") == pytest.approx(0.611111, abs=1e-6)
    assert one(spark, similarity.jaro_winkler(a, b), a="北京市", b="北京") == pytest.approx(0.911111, abs=1e-6)
    assert one(spark, similarity.char_jaccard(a, b), a="aab", b="abb") == 1.0
    for method in ("minhash", "edit", "jaro", "combined", "other"):
        assert one(spark, similarity.text_similarity(a, b, method), a="  ", b="x") == 0.0
        assert one(spark, similarity.text_similarity(a, b, method), a="same text", b="same text") == pytest.approx(1.0)


def test_administrative_similarity(spark):
    def score(x, y):
        names = ("province", "city", "district", "street")
        side = lambda v: {n: F.lit(p) for n, p in zip(names, v, strict=True)}
        return one(spark, similarity.administrative_similarity(side(x), side(y)), t="")

    assert score(("a", "b", "c", "d"), ("a", "b", "c", "d")) == pytest.approx(1.0)
    assert score(("a", "b", "c", "d"), ("z", "b", "c", "d")) == 0.0
    assert score((None, "b", "", ""), ("a", "b", "", "")) == pytest.approx(0.3)


def test_minhash_estimates_jaccard(spark):
    x, y = "abcdefghijklmnopqrstuvwxyz" * 2, "abcdefghijklmnopqrstuvw123" * 2
    exact = one(spark, similarity.ngram_jaccard(F.col("a"), F.col("b"), 3), a=x, b=y)
    near = one(spark, similarity.text_similarity(F.col("a"), F.col("b"), "minhash"), a=x, b=y)
    assert abs(exact - near) < 0.12


def test_geo(spark):
    four = [F.col(c) for c in "abcd"]
    assert one(spark, geo.haversine_km(*four), a=0.0, b=0.0, c=0.0, d=1.0) == pytest.approx(111.19, abs=0.01)
    assert one(spark, geo.haversine_km(*four), a=0.0, b=0.0, c=0.0, d=180.0) == pytest.approx(math.pi * 6371, abs=0.01)
    assert one(spark, geo.spatial_similarity(geo.haversine_km(*[geo.known(c) for c in four]), 10), a=float("nan"), b=0.0, c=0.0, d=0.0) == 0.0
    assert [one(spark, geo.cell(F.col("a"), 0.1), a=v) for v in (-0.05, -0.15, 0.15)] == [0, -1, 1]
    for document, clean, faithful in (
        ('{"offline_geocode":{"gcj02":"120.5,30.5","wgs84":"1,2"}}', (30.5, 120.5), (30.5, 120.5)), ('{"offline_geocode":{"gcj02":"bad","wgs84":"1,2"}}', (2.0, 1.0), None),
        ('{"offline_geocode":{"wgs84":"1,2"}}', (2.0, 1.0), (2.0, 1.0)), ("{}", None, None), ("not json", None, None), (None, None, None), ("", None, None),
    ):
        df = spark.createDataFrame([(document,)], "j string")
        row = df.select(geo.offline_point(F.col("j")).alias("c"), geo.offline_point(F.col("j"), True).alias("f")).first()
        assert (row["c"] and tuple(row["c"]), row["f"] and tuple(row["f"])) == (clean, faithful)
    for document in ("[30.5, 120.5]", '{"latitude": 30.5, "longitude": 120.5}'):
        assert tuple(one(spark, geo.read_coordinates(F.col("j")), j=document)) == (30.5, 120.5)


def test_config():
    assert EngineConfig().updated(mode="faithful").faithful
    with pytest.raises(TypeError):
        EngineConfig().updated(unknown=1)
    with pytest.raises(ValueError):
        EngineConfig(mode="other")
