"""Normalisation, tokens and numbers, as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize(text: Column | str, nfkc: bool = False) -> Column:
    """Lower case, & as "and", everything but letters, digits and _ as one space, trimmed; null is
    empty.  With ``nfkc`` the text is brought into that form first, ASCII staying in the JVM."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    if nfkc:
        ascii_only = text.rlike(r"^\p{ASCII}*$")
        # Python sees null, not the text, where the text is ASCII
        text = F.coalesce(F.when(ascii_only, text), _nfkc(F.when(~ascii_only, text)))
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}_]+", " "))


def country(value: Column | str, full: bool = False) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return normalize(value) if full else F.lower(F.trim(F.coalesce(value, F.lit(""))))


def tokens(text: Column | str, min_len: int = 2, distinct: bool = True) -> Column:
    """Tokens of a normalised text of at least ``min_len`` characters."""
    found = F.filter(F.split(text, " "), lambda t: F.length(t) >= max(1, min_len))
    return F.array_distinct(found) if distinct else found


def joined_tokens(*texts: Column | str, min_len: int = 2) -> Column:
    """Token set of several fields, white space collapsed between them."""
    return tokens(F.trim(F.regexp_replace(F.concat_ws(" ", *texts), r"\s+", " ")), min_len)


def token_column(name: str, kind: DataType) -> Column:
    """Tokens of a column that is a list already, or a string to split; empty ones are left out."""
    value = F.col(name) if isinstance(kind, ArrayType) else F.split(name, " ")
    return F.filter(value, lambda t: t != "")


def numbers(text: Column | str, distinct: bool = True, unicode_digits: bool = False) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\p{Nd}+" if unicode_digits else r"[0-9]+"), 0)
    return F.array_distinct(found) if distinct else found


def first_number(text: Column | str) -> Column:
    return F.regexp_extract(text, r"[0-9]+", 0)


def digits_only(text: Column | str) -> Column:
    return F.regexp_replace(text, r"\P{Nd}", "")
