from weft.llm import survivors


def test_hot_cluster_keeps_its_price(spark):
    """A price is a stand-in by the clusters that hold it, not by the rows of one."""
    texts = ", ".join(f"{c} string" for c in survivors.TEXTS)
    row = lambda c, i, p: (c, i, 1, None, float(p), 5, 1.0, *["x"] * len(survivors.TEXTS))
    rows = [row(0, i, 20.5) for i in range(100)] + [row(c, 1000 + c, 20.5 if c == 1 else 21 + c / 10) for c in range(1, 100)] + [row(c, 2000 + c, 12.34) for c in range(100, 120)]
    df = spark.createDataFrame(rows, "cluster_id long, row_id long, source_records long, updated_at timestamp, list_price double, inventory_count long, weight_lbs double, " + texts)
    got = {(r["cluster_id"], r["credible_price"]) for r in survivors.marked(df).where("list_price = 20.5 or list_price = 12.34").distinct().collect()}
    assert got == {(0, True), (1, True)} | {(c, False) for c in range(100, 120)}
