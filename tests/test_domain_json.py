import json

from pyspark.sql import functions as F

from weft.sources.writers import domain_json


def test_all_terms_of_a_block(spark):
    df = spark.range(2500).select(F.lit(1).alias("strong_id"), F.lit(0).alias("block_no"), F.lit(0.5).alias("weight"), F.format_string("t%05d", "id").alias("term"))
    got = domain_json(df).orderBy("chunk_no").collect()
    assert [t for r in got for t in json.loads(r["terms"])] == [f"t{i:05d}" for i in range(2500)]
    assert [r["chunk_no"] for r in got] == [0, 1, 2] and {r["term_count"] for r in got} == {2500}
