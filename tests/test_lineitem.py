from weft.plans import registry


def test_all_relational_tables(spark, data):
    want = {c for c in spark.read.parquet(f"{data}/lineitem.parquet").columns}
    for name in ("schema_overview", "infer_types_all"):
        got = {r["column"] for r in registry.QUERIES[name](spark, data).where("dataset = 'lineitem'").collect()}
        assert got == want, name
