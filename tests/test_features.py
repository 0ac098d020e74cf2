"""Pair features on known pairs, and properties of the similarities."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions import similarity as sim
from lodestone.functions.similarity import indel, lcs_length
from lodestone.operators import features

PAIRS = {
    "A": ("acme corp", "12 m g road 560001 560001", "acme corporation", "12 mg rd 560001 560001"),
    "B": ("abc", "", "abc", ""),
    "C": ("", "", "", ""),
    "D": ("tata tata motors", "x 1", "tata motors", "y 1"),
}
# Expected features of the pairs above, train and then serve.
EXPECTED = {
    "name_exact": ((0, 1, 1, 0), (0, 1, 0, 0)), "name_token_jaccard": ((1 / 3, 1, 1, 1), (1 / 3, 1, 1, 1)), "name_token_overlap": ((0.5, 1, 0, 1), (0.5, 1, 0, 1)),
    "name_prefix4": ((1, 0, 0, 1), (1, 1, 0, 1)), "name_suffix4": ((0, 0, 0, 1), (0, 1, 0, 1)), "name_shared_tokens": ((1, 1, 0, 2), (1, 1, 0, 2)),
    "addr_exact": ((0, 1, 1, 0), (0, 0, 0, 0)), "addr_token_jaccard": ((2 / 7, 1, 1, 1 / 3), (0.4, 1, 1, 1)), "addr_token_overlap": ((0.5, 0, 0, 0.5), (0.5, 0, 0, 0)),
    "addr_prefix4": ((1, 0, 0, 0), (1, 0, 0, 0)), "addr_suffix4": ((1, 0, 0, 0), (1, 0, 0, 0)), "addr_shared_tokens": ((2, 0, 0, 1), (2, 0, 0, 0)),
    "number_overlap": ((1, 0, 0, 1), (2 / 3, 0, 0, 1)), "digit_similarity": ((1, 1, 1, 1), (1, 1, 1, 1)), "name_char_sim": ((0.72, 1, 1, 0.814815), (0.72, 1, 0, 0.814815)), "addr_char_sim": ((0.93617, 1, 1, 0.666667), (0.93617, 0, 0, 0.666667)),
}


@pytest.mark.parametrize("profile", ["train", "serve"])
def test_known_pairs(spark, profile):
    df = spark.createDataFrame([(k, *v) for k, v in PAIRS.items()], "k string, s1_name string, s1_addr string, c_name string, c_addr string")
    rows = {r["k"]: r for r in features.features(df, ["k"], profile=profile).collect()}
    for name, by in EXPECTED.items():
        assert [rows[k][name] for k in "ABCD"] == pytest.approx(by[profile == "serve"], abs=1e-5), name
    assert {*features.NAMES} <= {*df.sparkSession.createDataFrame([rows["A"]]).columns} and len(features.NAMES) == 21


def test_legacy_has_fourteen(spark):
    df = spark.createDataFrame([("s", *PAIRS["A"], "en", "en", 2)], "k string, s1_name string, s1_addr string, c_name string, c_addr string, s1_country string, c_country string, cand_source int")
    row = features.legacy(df, ["k"]).first()
    assert len(row) == 15 and row["country_exact"] == 1 and row["candidate_source"] == 0


@pytest.mark.parametrize("a, b, ratio", [("kitten", "sitting", 0.61538462), ("abc", "abc", 1), ("ab", "xy", 0), ("straße nö", "strasse noe", 0.7)])
def test_indel(a, b, ratio):
    assert indel(a, b) == pytest.approx(ratio)


def _table(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("abé", max_size=40), st.text("abé", max_size=40))
@settings(max_examples=200, deadline=None)
def test_lcs_equals_table(a, b):
    assert lcs_length(a, b) == lcs_length(b, a) == _table(a, b)
    assert 0 <= indel(a, b) <= 1 and indel(a, a) == 1


@given(st.lists(st.text("abé", max_size=90), min_size=1, max_size=5), st.lists(st.text("abé", max_size=90), min_size=1, max_size=5), st.sampled_from([64, 300, 1 << 17]))
@settings(max_examples=100, deadline=None)
def test_lcs_of_many_equals_that_of_each(mine, other, row):
    before, sim.ROW = sim.ROW, row
    try:
        assert sim.lcs_lengths(mine, other).tolist() == [[lcs_length(a, b) for b in other] for a in mine]
    finally:
        sim.ROW = before
    assert sim.indels(mine, other, 1.0).ravel().tolist() == pytest.approx([indel(a, b) if a and b else float(a == b) for a in mine for b in other])
