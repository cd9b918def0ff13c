import pytest
from pyspark.sql import functions as F

from ledgerline.functions import numbers, text


@pytest.mark.parametrize(
    ("shown", "value"),
    [
        ("1 234,56", 1234.56), ("1.234,56", 1234.56), ("123,45", 123.45), ("123.45", 123.45), ("SEK 1 234,00", 1234), ("1 234,00 kr", 1234), ("-55,00", -55), ("55,00-", -55), ("1.234.567", 1234567), ("0", 0),
        ("", None), ("   ", None), ("12..3", None), ("abc", None), ("12,34,56", None), (None, None),
    ],
)
def test_parse_number(spark, shown, value):
    got = spark.range(1).select(numbers.parse_number(F.lit(shown).cast("string"))).first()[0]
    assert (float(got) if got is not None else None) == value


@pytest.mark.parametrize(("artifact", "band"), [("1.2.3", "COMPATIBLE"), ("1.2.4", "WARNING"), ("1.9.0", "WARNING"), ("2.0.0", "INCOMPATIBLE"), (None, "UNKNOWN"), ("x.y", "INCOMPATIBLE")])
def test_compatibility(spark, artifact, band):
    assert spark.range(1).select(text.compatibility(F.lit(artifact).cast("string"), F.lit("1.2.3"))).first()[0] == band


@pytest.mark.parametrize(("shown", "pair"), [("Sida 1/2", (1, 2)), ("page 2 av 3", (2, 3)), ("x 1/2 y", (1, 2)), ("Sida 3/2", None), ("none", None)])
def test_page_counter(spark, shown, pair):
    got = spark.range(1).select(text.page_counter(F.lit(shown))).first()[0]
    assert (tuple(got) if got else None) == pair


def test_content_score_bounds(spark):
    rows = spark.createDataFrame([("",), (None,), ("Faktura total 100 moms",), ("□□□□□□□□",)], "t string").select(text.content_score(F.col("t"))).collect()
    scores = [r[0] for r in rows]
    assert scores[0] == 0 and scores[1] == 0 and scores[2] > 0.7 > scores[3]


def test_discount(spark):
    d = spark.createDataFrame([("0.10", "100"), ("25", "100"), ("0.5", "0")], "d string, b string").select(F.col("d").cast("decimal(18,4)").alias("d"), F.col("b").cast("decimal(18,4)").alias("b"))
    assert [r[0] for r in d.select(numbers.discount_kind(F.col("d"), F.col("b"))).collect()] == ["percent", "amount", "amount"]
