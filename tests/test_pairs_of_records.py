import pytest

from weft import session
from weft.functions import metrics
from weft.operators import dedup
from weft.plans import registry

KIND = "row_id long, product_name string, brand string, list_price double"


def hot(spark, folder, n=1200):
    """n records of one block of three words, of which two are alike."""
    rows = [(i, f"for men women {i * 7919 % 100003:05d} {'xyz'[i % 3] * (i % 11)}", f"b{i}", 1.0 + i) for i in range(n)]
    rows.append((n, rows[0][1] + "a", "other", 1.0))
    spark.createDataFrame(rows, KIND).write.parquet(f"{folder}/deduplicated_output.parquet")
    return rows


def test_f4_a_hot_block_is_the_work_of_many_tasks(spark, tmp_path):
    n = len(hot(spark, tmp_path))
    df = registry.QUERIES["record_similarity"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 4
    assert df.count() == df.select("a", "b").distinct().count() == n * (n - 1) // 2


@pytest.mark.parametrize("same", [False, True])
def test_f4_pairs_are_those_of_the_two_joins(spark, same):
    """Nulls, placeholders, a second blocking with the same pairs, and keys that stand for two records."""
    rows = [(1, "a", "p", "x"), (2, "a", "p", "y"), (3, "a", "q", "z"), (4, None, "q", "u"), (5, "no_text", "r", None), (6, "no_text", "s", "v"), (None, "a", "p", "w"), (7, "p", "a", "t")]
    rows += [(1, "no_text", "q", "x2"), (2, "b", None, "y2")] if same else []
    df = spark.createDataFrame(rows, "id long, one string, two string, name string")
    got = sorted(map(str, dedup.paired(df, "id", ["one", "two"], ["name"]).collect()))
    assert got and got == sorted(map(str, dedup.with_sides(dedup.candidate_pairs(df, "id", ["one", "two"]), df, "id", ["name"]).drop("block_key").collect()))


def test_f2_only_similar_pairs_are_written(spark, tmp_path):
    """The clusters of all pairs, without a table of all pairs."""
    n = len(hot(spark, tmp_path, 400))
    before = {p for _, p in session._written}
    got = {r["node"]: r["component"] for r in registry.QUERIES["duplicate_clusters"](spark, str(tmp_path)).collect()}
    sizes = [spark.read.parquet(p).count() for _, p in session._written if p not in before]
    assert sizes and max(sizes) < n * (n - 1) // 2
    pairs = registry.QUERIES["record_similarity"](spark, str(tmp_path)).where("sim > 0.8").collect()
    root = {i: i for i in range(n)}
    for _ in range(n):
        moved = False
        for r in pairs:
            low = min(root[r["a"]], root[r["b"]])
            moved |= root[r["a"]] != low or root[r["b"]] != low
            root[r["a"]] = root[r["b"]] = low
        if not moved:
            break
    assert pairs and got == root


def test_f3_levels_of_a_hot_block_are_the_work_of_many_tasks(spark, tmp_path):
    name = {i: v for i, v, *_ in hot(spark, tmp_path)}
    df = registry.QUERIES["linkage_levels"](spark, str(tmp_path))
    assert df.columns == ["a", "b", "jw", "level"] and df.rdd.getNumPartitions() > 4
    for r in df.where("a < 3").collect():
        jw = metrics.jaro_winkler_value(name[r["a"]].strip(), name[r["b"]].strip())
        assert abs(r["jw"] - jw) < 1e-6 and r["level"] == (2 if r["jw"] >= 0.9 else 1 if r["jw"] >= 0.7 else 0)
