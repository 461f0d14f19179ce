"""The general problems on small fixtures: brute force, odd and empty input."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import drift, quality, weights
from weft.operators import unify as U
from weft.session import exact_quantile, grouped_quantiles, running_total
from weft.sources import readers, writers


def feed(rows):
    return [(i, f, "s", n, f"f{n}", datetime(2025, 1, 1), i, json.dumps(p) if isinstance(p, dict) else p, "extra") for i, (f, n, p) in enumerate(rows)]


FEED = "record_no long, feed_id long, system_name string, file_no int, file_name string, received_at timestamp, line_no int, payload string, name string"


def test_drift(spark):
    a = [(1, 1, {"sku": f"PROD-{i:05d}", "price": i + 0.5, "brand": "Acme", "seen": True}) for i in range(12)]
    b = [(1, 3, {"stock_code": {"id": f"PROD-{i:05d}"}, "price": f"${i}.25", "brand": None if i % 2 else "Acme", "grade": "A"}) for i in range(12)]
    odd = [(1, 3, "not json"), (1, 3, None), (1, 3, "[1]")]
    got = {(r["change_kind"], r["old_name"], r["new_name"]) for r in drift.changes(spark.createDataFrame(feed(a + b + odd), FEED)).collect()}
    assert got == {("renamed", "sku", "stock_code"), ("retyped", "sku", "stock_code"), ("retyped", "price", "price"), ("removed", "seen", ""), ("added", "", "grade")}
    t = drift.unified(spark.createDataFrame(feed(a + b + odd), FEED))
    assert t.count() == 27 and dict(t.dtypes)["price"] == "double" and "sku" in t.columns and "stock_code" not in t.columns
    assert t.where("sku is not null").count() == 24


def test_drift_broadcasts_nothing_that_grows(spark, tmp_path):
    """Written tables look small to the planner; what has a row per file and name is merged all the same."""
    rows = [(f, n, {"sku" if n < 2 + f % 2 else "code": f"PROD-{i:05d}", "price": i + 0.5}) for f in range(300) for n in (1, 2, 3) for i in (f, f + 1)]
    records = spark.createDataFrame(feed(rows), FEED)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    sizes = []
    store = spark._jsparkSession.sharedState().statusStore()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        first = store.executionsCount()
        log = drift.changes(records)
        assert log.where("change_kind = 'renamed'").count() == 300
        runs = store.executionsList()
        for i in range(first, runs.size()):
            execution = runs.apply(i).executionId()
            metrics = store.executionMetrics(execution)
            nodes = store.planGraph(execution).allNodes()
            for k in range(nodes.size()):
                if nodes.apply(k).name() == "BroadcastExchange":
                    ms = nodes.apply(k).metrics()
                    for m in range(ms.size()):
                        if ms.apply(m).name() == "number of output rows":
                            said = metrics.get(ms.apply(m).accumulatorId())
                            sizes.append(int(said.get().replace(",", "")) if said.isDefined() else 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # 900 files, 300 feeds; the names and their pairs are a few.
    assert runs.size() > first and max(sizes, default=0) < 100


def test_drift_reads_texts_to_their_end(spark):
    """Two fields whose texts begin alike, in words, letters and shape, and differ behind: each is found again under its new name."""
    head = "the very same beginning of every text, "
    care, ship = "wash by hand only", "leaves from warehouse seven"
    a = [(1, 1, {"care": f"{head}{care}", "ship": f"{head}{ship}"}) for _ in range(8)]
    b = [(1, 2, {"note_a": f"{head}{ship}", "note_b": f"{head}{care}"}) for _ in range(8)]
    log = drift.changes(spark.createDataFrame(feed(a + b), FEED)).collect()
    assert {(r["change_kind"], r["old_name"], r["new_name"]) for r in log} == {("renamed", "care", "note_b"), ("renamed", "ship", "note_a")}
    values = drift.fields(spark.createDataFrame(feed([(1, 1, {"o": {"v": 'a, "b" c'}, "n": {"v": None}})]), FEED))
    assert {r["name"]: r["leaf"] for r in values.collect()} == {"o": 'a, "b" c', "n": None}


def test_drift_of_nothing(spark):
    df = spark.createDataFrame([], FEED)
    assert drift.changes(df).count() == 0
    assert drift.unified(df).count() == 0


def ks(a, b):
    v = np.unique(np.concatenate([a, b]))
    return max(abs(np.searchsorted(np.sort(a), v, "right") / len(a) - np.searchsorted(np.sort(b), v, "right") / len(b)))


def test_curves_are_exact(spark):
    r = np.random.default_rng(3)
    loads = {1: r.normal(10, 2, 300).round(1), 2: r.normal(10, 2, 200).round(1), 3: r.normal(14, 2, 250).round(1), 4: r.normal(10, 2, 220).round(1)}
    rows = [(k, float(x), "t") for k, xs in loads.items() for x in xs] + [(1, None, None), (None, 1.0, "")]
    df = spark.createDataFrame(rows, "load_no int, v double, s string")
    counts = quality.unpivot(df, "t", "load_no", ["v"]).where("value is not null").groupBy("table_name", "column_name", "load_no", "value").count().withColumnRenamed("count", "n")
    c = quality._curves(counts).collect()
    for x in c:
        if x["kind"] == "ks":
            assert x["d"] == pytest.approx(ks(loads[x["a"]], loads[x["b"]]))
        else:
            xs = np.sort(loads[x["a"]])
            assert x["d"] == xs[max(0, int(np.ceil(quality.QUANTILES[x["b"]] * len(xs) - 1e-9)) - 1)]
    p = {x["load_no"]: x for x in quality.profile(quality.unpivot(df, "t", "load_no", ["v"])).collect()}
    assert [k for k in p if p[k]["departs"]] == [3]
    assert p[1]["null_share"] == pytest.approx(1 / 301, abs=1e-6)
    assert quality.profile(quality.unpivot(df.limit(0), "t", "load_no")).count() == 0


def test_curves_of_many_loads(spark):
    """More loads than one array of distances holds: all pairs, in several blocks."""
    r = np.random.default_rng(5)
    loads = {k: r.integers(0, 40, 3 + k % 4) + (100.0 if k == 7 else 0.0) for k in range(530)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in loads.items() for x in xs], "load_no int, v double")
    cells = quality.unpivot(df, "t", "load_no", ["v"])
    c = quality._curves(cells.groupBy("table_name", "column_name", "load_no", "value").count().withColumnRenamed("count", "n")).toPandas()
    d = c[c["kind"] == "ks"].set_index(["a", "b"])["d"]
    assert len(d) == 530 * 529
    for a, b in [(0, 1), (7, 300), (529, 7), (263, 264), (264, 263), *r.integers(0, 265, (30, 2)) * 2 + [0, 1]]:
        assert d[(a, b)] == pytest.approx(ks(loads[a], loads[b]))
    q = c[c["kind"] == "q"].set_index(["a", "b"])["d"]
    assert len(q) == 530 * len(quality.QUANTILES) and all(q[(k, 3)] == np.sort(x)[(len(x) + 1) // 2 - 1] for k, x in loads.items())
    assert quality.profile(cells).count() == 530


def test_text_number(spark):
    v = ["$12.50", "12,50", "12.50 USD", "tbc", "", None, "1,234.50", "-3.1"]
    got = spark.createDataFrame([(x,) for x in v], "v string").select(quality.text_number(F.col("v"))).collect()
    assert [r[0] for r in got] == [12.5, 12.5, 12.5, None, None, None, 1234.5, -3.1]


MODERN = "row_no long, asin string, title string, weight_kg double, specifications string, name string"
THIRD = "row_no long, item_code string, item_name string, item_weight string, v string"
LEGACY = "row_no long, product_sku string, product_name string, weight_lbs double"


def test_units(spark):
    spec = '{"weight": "2.0 kg"}'
    m = [(1, "B1", "Mat Abc Defghi", 2.0, spec, ""), (2, "B1", "Mat", 2000.0, None, ""), (3, "B1", "Mat", 4.409, None, ""), (4, "B2", None, None, "{", ""), (5, None, None, 1.0, None, ""), (6, "B3", "", -1.0, "", ""), (7, "B1", "Mat", float("nan"), None, "")]
    t = [(1, "I1", "Lamp", "3 lb 4 oz", ""), (2, "I1", "Lamp", "1474", ""), (3, "I1", "Lamp", "see label", ""), (4, "I1", "Lamp", None, "")]
    lg = [(1, "B1", "Mat", 2.0), (2, "B1", "Mat", 4.4), (3, "P1", "Mat", 4.4)]
    got = weights.catalogue_weights(spark.createDataFrame(m, MODERN), spark.createDataFrame(t, THIRD), spark.createDataFrame(lg, LEGACY))
    u = {(r["table_name"][:1], r["row_no"]): r["unit"] for r in got.collect()}
    assert u == {("m", 1): "kg", ("m", 2): "g", ("m", 3): "lb", ("m", 4): None, ("m", 5): "kg", ("m", 6): None, ("m", 7): None, ("t", 1): "lb oz", ("t", 2): "g", ("t", 3): None, ("t", 4): None, ("c", 1): "kg", ("c", 2): "lb", ("c", 3): "lb"}
    empty = weights.catalogue_weights(spark.createDataFrame([], MODERN), spark.createDataFrame([], THIRD), spark.createDataFrame([], LEGACY))
    assert empty.count() == 0


def test_running_total(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1)).alias("o"), (F.col("id") % 7).alias("v"))
    got = running_total(df, ["g"], F.col("o"), "v", "before", 16).collect()
    for g in (0, 1):
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["o"]):
            assert r["before"] == total
            total += r["v"]


def test_merges(spark):
    a, b = spark.createDataFrame([(1, "x", None), (2, "y", 1.0)], "k int, n string, p double"), spark.createDataFrame([(2, "z", 3.0), (3, "w", 4.0)], "k int, n string, p double")
    v = {r["k"]: (r["n"], r["p"]) for r in U.coalesced(U.vertical([a, b], "k"), ["n", "p"]).collect()}
    assert v == {1: ("x", None), 2: ("y", 1.0), 3: ("w", 4.0)}
    assert U.horizontal([a, b.withColumnRenamed("n", "m")]).columns == ["k", "m", "n", "p"]
    assert sorted(r["k"] for r in U.hybrid([a, b], "k", ["n"]).collect()) == [1, 2, 3]
    assert U.choose_strategy(1, 0.1, [["a", "b"], ["b"]]).key == "b"
    assert U.choose_strategy(1, 0.9, []).kind == "horizontal"
    assert U.merge_key([a, b], ["p", "k"]) == "p"


def test_sources(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_bytes("Name (x),n\ncaf\xe9,1\n".encode("latin-1"))
    (tmp_path / "b.json").write_text('[{"a": 1, "b": {"c": 2}}, {"a": 3}]')
    (tmp_path / "c.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert set(readers.files(str(tmp_path))) == {"a.csv", "b.json", "c.json"}
    csv = readers.read_csv(spark, str(tmp_path / "x" / "a.csv"), text=True, clean_names=True)
    assert csv.columns == ["name_x", "n"] and csv.first()["name_x"] == "café"
    assert readers.read_any(spark, str(tmp_path / "b.json")).columns == ["a", "b.c"]
    assert readers.read_any(spark, str(tmp_path / "c.json")).count() == 2
    writers.write_golden(spark.createDataFrame([(1.0, "t", "u")], "p double, t string, t_clean string"), str(tmp_path / "g"))
    assert spark.read.csv(str(tmp_path / "g"), header=True).first().asDict() == {"p": "1.00", "t": "t"}
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.doc")


def test_stream(spark, data, tmp_path):
    from weft.streaming import incremental as I

    batch = spark.read.parquet(f"{data}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.write.mode("overwrite").parquet(str(tmp_path / "in"))
    s = I.windowed(I.stream(spark, str(tmp_path / "in"), batch.schema))
    I.run_once(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    got, want = spark.read.parquet(str(tmp_path / "out")), I.windowed(batch)
    # The newest windows stay open until the watermark passes them.
    assert got.count() > 0 and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_quantiles(spark, n):
    r = np.random.default_rng(n)
    x = [float(v) for v in r.integers(0, 40, n)]
    df = spark.createDataFrame([("a", v) for v in x] + [("a", None), ("b", None)], "g string, v double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        want = float(np.quantile(x, q)) if n else None
        got = {w["g"]: w["q"] for w in grouped_quantiles(df, ["g"], "v", q, "q").collect()}
        assert got == ({"a": pytest.approx(want)} if n else {})
        assert exact_quantile(df, "v", q) == (pytest.approx(want) if n else None)
