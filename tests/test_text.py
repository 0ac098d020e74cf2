"""Normalisation, tokens and numbers."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text

CASES = [("Acme & Sons, Pvt. Ltd.", "acme and sons pvt ltd", "acme and sons pvt ltd"), ("  Café--Déjà_Vu ", "café déjà_vu", "café déjà_vu"), ("ＡＣＭＥ ①", "ａｃｍｅ ①", "acme 1"), ("हिन्दी स्टोर", "ह न द स ट र", "ह न द स ट र"), (None, "", ""), ("", "", "")]


@pytest.mark.parametrize("raw, plain, nfkc", CASES)
def test_normalize(spark, raw, plain, nfkc):
    df = spark.createDataFrame([(raw,)], "t string")
    assert tuple(df.select(text.normalize("t"), text.normalize("t", nfkc=True)).first()) == (plain, nfkc)


def test_tokens_and_numbers(spark):
    df = spark.createDataFrame([("a bb bb 12 m 7",), ("",)], "t string")
    found = df.select(text.tokens("t"), text.tokens("t", 1), text.tokens("t", 2, False), text.numbers("t"), text.first_number("t"), text.digits_only("t")).collect()
    assert [*found[0]] == [["bb", "12"], ["a", "bb", "12", "m", "7"], ["bb", "bb", "12"], ["12", "7"], "12", "127"]
    assert [*found[1]] == [[], [], [], [], "", ""]


def test_token_column_takes_lists_and_strings(spark):
    for df in (spark.createDataFrame([(["x", "", "yy"],)], "t array<string>"), spark.createDataFrame([("x  yy",)], "t string")):
        assert df.select(text.token_column("t", df.schema["t"].dataType)).first()[0] == ["x", "yy"]


def test_country(spark):
    df = spark.createDataFrame([(" FR. ",), (None,)], "c string")
    assert [tuple(r) for r in df.select(text.country("c"), text.country("c", full=True)).collect()] == [("fr.", "fr"), ("", "")]
    assert df.select(F.count("*")).first()[0] == 2
