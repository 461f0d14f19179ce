import random
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import functions as F

from weft.functions import batches, metrics
from weft.operators.pairs import every_pair


def texts(letters, most, seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice(letters) for _ in range(r.randint(0, n)))
    a = [word(most) for _ in range(150)] + [None, "", "", "x"]
    b = [x[: len(x) // 2] + word(most // 2) if x and r.random() < 0.5 else word(most) for x in a[:-4]] + ["x", "", "x", None]
    return a, b


def test_batches_are_the_single_values():
    ratio = lambda s, t: SequenceMatcher(None, s, t).ratio()
    for fn, one in ((batches.difflib_ratios, ratio), (batches.jaro_winkler_values, metrics.jaro_winkler_value)):
        for letters in ("ab", "abcdefghij 0123", "aéß漢😀"):
            for most in (4, 63, 66, 260):
                a, b = texts(letters, most, most)
                assert fn(pa.array(a, pa.string()), pa.array(b, pa.string())).to_pylist() == [None if x is None or y is None else one(x, y) for x, y in zip(a, b)]


def test_every_pair_is_made_by_many_tasks(spark):
    names = [f"brand {i}" for i in range(1100)]
    pairs = every_pair(spark.createDataFrame([(v,) for v in [*names, *names[:9], None]], "v string"))
    per = pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per) > 2 and max(r["count"] for r in per) < 1100 * 1099 // 2
    assert sum(r["count"] for r in per) == pairs.distinct().count() == 1100 * 1099 // 2
    assert pairs.where("a >= b").isEmpty()
