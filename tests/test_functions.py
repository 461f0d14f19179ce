import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.functions import infer, metrics, text
from weft.functions.units import number, quantities, segment, weight


@pytest.mark.parametrize(
    ("s", "want"),
    [("Wt: 21.3 OZ", (21.3, "oz")), ("3# 1.4oz", (3.0875, "lb oz")), ("net 9074g", (9074, "g")), ("0,417 kg", (0.417, "kg")), ("8.641 Kilogramm", (8.641, "kg")), ("1199", (1199, "")), ("~0.716 kilos", (0.716, "kg")), ("2 lbs. 14.5 oz.", (2.90625, "lb oz")), ("5 KGS", (5, "kg")), ("7 GR", (7, "g")), ("see label", None), ("", None), (None, None), ("-", None)],
)
def test_weights(s, want):
    got = weight(s)
    assert got is None if want is None else (pytest.approx(got[0]), got[1]) == want


def test_priors_decide():
    assert segment("m", {"length": 0.9})[1] == "length"
    assert segment("min")[1] == "time"
    assert segment("sq ft")[1] == "length^2"
    assert segment("fl oz")[1] == "volume"
    assert segment("xyz") is None
    assert segment(None) is None
    assert [q[1] for q in quantities("10.6 qt, 2 lb")] == ["qt", "lb"]


@given(st.floats(0.001, 9999).map(lambda x: round(x, 3)))
def test_number_round_trip(x):
    assert number(str(x), grouped=False) == x
    assert number(str(x).replace(".", ","), grouped=False) == x


def test_text(spark):
    rows = [("  A\t b ", "$1,234.5", "a-b_c/d.e!"), (None, None, None), ("{'name': 'X y', 'value': 3}", "10-20", ""), ("", "-5 kg", "É 9"), ("{broken", "no", "  ")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = df.select(text.clean_text(F.col("a")), text.extract_number(F.col("b")), text.clean_tokens(F.col("c")), text.run_pattern(F.col("a"))).collect()
    assert [r[0] for r in got] == ["a b", "", "X y 3", "", "{broken"]
    assert [r[1] for r in got] == [1234.5, None, 15.0, -5.0, None]
    assert [r[2] for r in got] == ["a b c d e", "", "", "9", ""]
    one = spark.createDataFrame([("customer_id", "10k")], "a string, b string").select(text.run_pattern(F.col("a")), text.byte_size(F.col("b")), text.value_shape(F.col("a"))).first()
    assert tuple(one) == ("L8SL2", 10240, "LLLLLLLL_LL")
    assert text.column_name(" Total (USD) ") == "total_usd"
    assert text.column_name("?!") == "unnamed_column"


def test_types(spark):
    cases = {"boolean": ["yes", "no", "1"], "integer": ["1", "22", "-3"], "float": ["2023", "2024", "1999"], "datetime": ["1/2/2020", "3/4/2021", "x"], "string": ["2023-01-15", "2023-02-20"], "unknown": [None]}
    rows = [(k, v) for k, vs in cases.items() for v in vs]
    got = spark.createDataFrame(rows, "k string, v string").groupBy("k").agg(infer.inferred_type(F.col("v")).alias("t")).collect()
    assert {r["k"]: r["t"] for r in got} == {k: k for k in cases}
    v = ["$1,200", "3000000000", "4.5%", "(1.5, 2.5)", "12/31/2020", "abc"]
    got = spark.createDataFrame([(x,) for x in v], "v string").select(infer.annotated_type(F.col("v"))).collect()
    assert [r[0] for r in got] == ["integer", "long", "decimal", "geo", "date", "text"]


def test_similarity_vectors(spark):
    df = spark.createDataFrame([(5, 4, 3), (5, 3, 2), (4, 3, 2), (5, 3, 0)], "a int, b int, o int")
    got = df.select(metrics.jaccard(F.col("a"), F.col("b"), F.col("o")), metrics.log_jaccard(F.col("a"), F.col("b"), F.col("o"))).collect()
    assert [round(r[0], 6) for r in got] == [0.5, round(2 / 6, 6), 0.4, 0]
    assert [round(r[1], 6) for r in got] == [round(math.log(4) / math.log(7), 6), round(math.log(3) / math.log(7), 6), round(math.log(3) / math.log(6), 6), 0]
    assert metrics.jaro_winkler_value("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert metrics.jaro_winkler_value("", "") == 0


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_jaro_bounds(a, b):
    x = metrics.jaro_winkler_value(a, b)
    assert 0 <= x <= 1 and x == pytest.approx(metrics.jaro_winkler_value(b, a), abs=0.2)


def test_thresholds(spark):
    df = spark.createDataFrame([(0.5,), (0.3 + 0.2,), (0.51,)], "x double")
    assert df.where(metrics.threshold("GT0.5")(F.col("x"))).count() == 1
    assert df.where(metrics.threshold("GEQ0.5")(F.col("x"))).count() == 3
    with pytest.raises(ValueError):
        metrics.threshold("x")
