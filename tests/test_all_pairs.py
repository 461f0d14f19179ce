from weft.plans import registry


def test_pairs_of_different_beginnings(spark, tmp_path):
    names = ["altomotive", "atomotive", "bby products", "baby prodcts", "garden"]
    spark.createDataFrame([(v,) for v in names], "category string").write.parquet(f"{tmp_path}/modern_products.parquet")
    spark.createDataFrame([(v,) for v in names], "brand_name string").write.parquet(f"{tmp_path}/third_system_products.parquet")
    got = {(r["a"], r["b"]) for r in registry.QUERIES["bounded_similarity"](spark, str(tmp_path)).collect()}
    assert got == {("altomotive", "atomotive"), ("baby prodcts", "bby products")}
    got = {(r["a"], r["b"]) for r in registry.QUERIES["difflib_brands"](spark, str(tmp_path)).collect()}
    assert got == {(a, b) for a in names for b in names if a < b}
