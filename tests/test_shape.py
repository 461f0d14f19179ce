from pyspark.sql import functions as F

from weft.operators.quality import shape


def test_shapes_differ_behind_their_beginning(spark):
    long = "a-1 " * 10
    rows = [(long + "x",), (long + "7",), (long + "yz",), ("ab-12",), (None,)]
    a, b, c, d, e = [r[0] for r in spark.createDataFrame(rows, "v string").coalesce(1).select(shape(F.col("v"))).collect()]
    assert a == c != b and d == "a-9" and e is None
