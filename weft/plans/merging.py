"""Queries that harmonise, merge and deduplicate."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import metrics, text
from weft.operators import dedup as E
from weft.operators import unify as U
from weft.plans.query import query
from weft.plans.texts import JW
from weft.session import cut, table

GOLDEN = {"product_sku": "string", "product_name": "string", "product_category": "string", "brand": "string", "list_price": "double", "weight_lbs": "double", "is_active": "boolean", "inventory_count": "int"}
MODERN = {"asin": "product_sku", "title": "product_name", "category": "product_category", "current_price": "list_price", "stock_quantity": "inventory_count"}
THIRD = {"item_code": "product_sku", "item_name": "product_name", "category_name": "product_category", "brand_name": "brand", "retail_price": "list_price", "stock_level": "inventory_count"}


def _harmonised(spark, d):
    a = U.harmonise(table(spark, d, "modern_products").select("row_no", *MODERN, "brand"), U.Plan(GOLDEN, MODERN, "modern", 2))
    b = U.harmonise(table(spark, d, "third_system_products").select("row_no", *THIRD), U.Plan(GOLDEN, THIRD, "third", 2))
    return a, b


H = """h as (select asin as product_sku, title as product_name, category as product_category, brand, current_price as list_price, null::double as weight_lbs, null::boolean as is_active, stock_quantity as inventory_count, 'modern' as _source_file, 2 as _cluster_id, row_no from modern_products
union all select item_code, item_name, category_name, brand_name, try_cast(retail_price as double), null, null, stock_level, 'third', 2, row_no from third_system_products)"""


@query(f"with {H} select * from h")
def harmonize_products(spark, d):
    a, b = _harmonised(spark, d)
    return a.unionByName(b)


@query("select c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey, null::double as s_acctbal, null::varchar as s_name, null::integer as s_nationkey, null::bigint as s_suppkey from customer union all select null, null, null, null, null, s_acctbal, s_name, s_nationkey, s_suppkey from supplier")
def horizontal_merge(spark, d):
    return U.horizontal([table(spark, d, "customer"), table(spark, d, "supplier")])


@query("select coalesce(c_custkey, o_custkey) as custkey, c_name, c_acctbal, o_orderkey, o_totalprice from customer full outer join orders on c_custkey = o_custkey")
def vertical_merge(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_name", "c_acctbal")
    return U.vertical([c, table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice")], "custkey")


@query(f"with {H}, k as (select *, row_number() over (partition by product_sku order by case _source_file when 'modern' then 0 else 1 end, row_no) as k from h) select * exclude (k) from k where k = 1")
def hybrid_merge_first(spark, d):
    return U.hybrid(list(_harmonised(spark, d)), "product_sku", ["row_no"])


@query("""select coalesce(a.k, b.k) as k, coalesce(a.brand, b.brand) as brand, coalesce(a.price, b.price) as price
from (select product_sku as k, max(brand) as brand, max(list_price) as price from cluster_2_unified group by 1) a full join (select asin as k, max(brand) as brand, max(current_price) as price from modern_products group by 1) b on a.k = b.k""")
def coalesce_columns(spark, d):
    a = table(spark, d, "cluster_2_unified").groupBy(F.col("product_sku").alias("k")).agg(F.max("brand").alias("brand"), F.max("list_price").alias("price"))
    b = table(spark, d, "modern_products").groupBy(F.col("asin").alias("k")).agg(F.max("brand").alias("brand"), F.max("current_price").alias("price"))
    return U.coalesced(U.vertical([a, b], "k"), ["brand", "price"])


@query("""select row_no, try_cast(round(try_cast(retail_price as double)) as bigint) as as_int, try_cast(retail_price as double) as as_float, lower(trim(availability_status)) in ('true', 'yes', 'y', '1', 't') as as_bool, try_cast(stock_level as varchar) as as_text from third_system_products""")
def type_convert(spark, d):
    t = table(spark, d, "third_system_products")
    return t.select("row_no", U.convert(F.col("retail_price"), "string", "int").alias("as_int"), U.convert(F.col("retail_price"), "string", "float").alias("as_float"), U.convert(F.col("availability_status"), "string", "bool").alias("as_bool"), U.convert(F.col("stock_level"), "bigint", "str").alias("as_text"))


ACTIVE = "('true', 'yes', 'y', '1', 't')"


@query(f"select row_no, product_sku, lower(trim(is_active)) in {ACTIVE} as active, coalesce(source_file, 'unknown') as source from cluster_2_unified where lower(trim(is_active)) in {ACTIVE} or is_active is null")
def filter_active(spark, d):
    """A predicate that is pushed to the scan as far as it can be, and a projection of four columns."""
    t = table(spark, d, "cluster_2_unified")
    a = U.convert(F.col("is_active"), "string", "bool")
    return t.where(a | F.col("is_active").isNull()).select("row_no", "product_sku", a.alias("active"), F.coalesce("source_file", F.lit("unknown")).alias("source"))


@query("select distinct brand as v from modern_products where brand is not null and brand not in (select brand_name from third_system_products where brand_name is not null)")
def unmapped_values(spark, d):
    a = table(spark, d, "modern_products").select(F.col("brand").alias("v")).where("v is not null").distinct()
    return a.join(table(spark, d, "third_system_products").select(F.col("brand_name").alias("v")), "v", "left_anti")


@query("(select brand as v from modern_products intersect select brand_name from third_system_products) except select brand from deduplicated_output")
def set_operations(spark, d):
    a, b = table(spark, d, "modern_products").select(F.col("brand").alias("v")), table(spark, d, "third_system_products").select(F.col("brand_name").alias("v"))
    return a.intersect(b).exceptAll(table(spark, d, "deduplicated_output").select(F.col("brand").alias("v")).distinct())


B = """select row_id, coalesce(substr(product_sku, 1, 10), 'no_id') as block_id, case when coalesce(product_name, '') = '' then 'no_text' else substr(array_to_string(list_filter(string_split_regex(product_name, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')[1:3], '_'), 1, 30) end as block_text,
case when list_price is null then 'nan' when list_price <= (select quantile_cont(list_price, 0.25) from deduplicated_output) then 'low' when list_price <= (select quantile_cont(list_price, 0.75) from deduplicated_output) then 'medium' else 'high' end as block_num from deduplicated_output"""


def _blocked(spark, d):
    t = table(spark, d, "deduplicated_output")
    return E.number_blocks(t, "list_price", "block_num").withColumn("block_id", E.id_block(F.col("product_sku"))).withColumn("block_text", E.text_block(F.col("product_name")))


@query(B)
def block_keys(spark, d):
    return _blocked(spark, d).select("row_id", "block_id", "block_text", "block_num")


REC = """r as (select min(row_id) as id, product_name as name, brand, round(median(list_price) filter (list_price > 0), 4) as price from (select row_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(product_name), '[-_./]', ' ', 'g'), '[^a-z0-9 \\t\\n\\r\\f\\v]', '', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) as product_name, coalesce(lower(brand), '') as brand, list_price from deduplicated_output where product_name is not null) where product_name <> '' group by product_name, brand),
k as (select *, substr(array_to_string(string_split(name, ' ')[1:3], '_'), 1, 30) as block_text, brand || '|' || string_split(name, ' ')[-1] as block_brand from r),
p as (select a, b, min(i) as i from (select a.id as a, b.id as b, 0 as i from k a join k b on a.block_text = b.block_text and a.id < b.id union all select a.id, b.id, 1 from k a join k b on a.block_brand = b.block_brand and a.id < b.id where a.brand <> '') group by 1, 2)"""


def _records(spark, d):
    """Distinct (name, brand) of the deduplicated table with the median price: copies are one record."""
    t = table(spark, d, "deduplicated_output").where("product_name is not null").select("row_id", text.clean_tokens(F.col("product_name")).alias("name"), F.coalesce(F.lower("brand"), F.lit("")).alias("brand"), "list_price").where("name <> ''")
    r = t.groupBy("name", "brand").agg(F.min("row_id").alias("id"), F.round(F.median(F.when(F.col("list_price") > 0, F.col("list_price"))), 4).alias("price"))
    r = r.withColumn("block_text", E.text_block(F.col("name"))).withColumn("block_brand", F.when(F.col("brand") != "", F.concat_ws("|", "brand", F.element_at(F.split("name", " "), -1))))
    return cut(r)


@query(f"with {REC} select a, b, case i when 0 then 'block_text' else 'block_brand' end as block_key from p")
def candidate_pairs(spark, d):
    return E.candidate_pairs(_records(spark, d), "id", ["block_text", "block_brand"])


SIM = f"""s as (select p.a as ia, p.b as ib, x.name as a, y.name as b, x.brand as ba, y.brand as bb, x.price as pa, y.price as pb from p join r x on x.id = p.a join r y on y.id = p.b),
t as (select ia, ib, case when a = b then 1.0 else greatest({JW}, len(list_intersect(list_distinct(string_split(a, ' ')), string_split(b, ' ')))::double / len(list_distinct(string_split(a, ' ') || string_split(b, ' ')))) end as ts,
case when pa is null or pb is null then null when greatest(abs(pa), abs(pb)) = 0 then 1.0 else greatest(0.0, 1 - abs(pa - pb) / greatest(abs(pa), abs(pb))) end as ns from s),
sim as (select ia as a, ib as b, round((0.5 * ts + coalesce(0.35 * ns, 0)) / (0.5 + case when ns is null then 0 else 0.35 end), 6) as sim from t)"""


def _similar(spark, d, above=None):
    r = _records(spark, d)
    return r, E.similar_pairs(r, "id", ["block_text", "block_brand"], {"name": 0.5}, {"price": 0.35}, above)


@query(f"with {REC}, {SIM} select a, b, sim from sim")
def record_similarity(spark, d):
    return _similar(spark, d)[1]


@query()
def duplicate_clusters(spark, d):
    """Components of the similar records; every record has one."""
    r, s = _similar(spark, d, E.SIMILAR)
    return E.clusters(s, r, "id")


def _text(c: str) -> str:
    return f"coalesce(arg_max(trim({c}), length(trim({c})) * 1000000000 - row_id) filter (length(trim({c})) > 3), arg_min(trim({c}), row_id) filter (trim({c}) <> '')) as {c}"


@query(f"select cluster_id, count(*) as source_records, median(list_price) as list_price, median(weight_lbs) as weight_lbs, {_text('product_name')}, {_text('brand')}, {_text('product_category')} from deduplicated_output group by 1")
def golden_records(spark, d):
    return E.golden_records(table(spark, d, "deduplicated_output"), "cluster_id", "row_id", ["list_price", "weight_lbs"], ["product_name", "brand", "product_category"])


@query("select count(*) as rows, (count(*) - (select count(*) from (select distinct asin, title, category, brand, current_price, stock_quantity from modern_products)))::bigint as duplicates from modern_products")
def exact_dup_rows(spark, d):
    g = table(spark, d, "modern_products").groupBy("asin", "title", "category", "brand", "current_price", "stock_quantity").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("rows"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


@query("select asin, row_no, title from (select *, row_number() over (partition by asin order by updated_at desc, row_no) as k from modern_products) where k = 1")
def drop_duplicates_first(spark, d):
    return E.first_of(table(spark, d, "modern_products").select("asin", "row_no", "title", "updated_at"), ["asin"], [F.desc("updated_at"), "row_no"]).select("asin", "row_no", "title")


@query()
def minhash_pairs(spark, d):
    """Similar part names by MinHash buckets (X1)."""
    return E.minhash_pairs(table(spark, d, "part").select(F.col("p_name")).distinct().withColumn("k", F.col("p_name")), "k", "p_name")


@query()
def linkage_levels(spark, d):
    """Agreement levels of candidate pairs by Jaro-Winkler, without training (X5)."""
    r = _records(spark, d)
    p = E.paired(r, "id", ["block_text", "block_brand"], ["name"])
    j = metrics.jaro_winkler("name_a", "name_b")
    return p.withColumn("jw", F.round(j, 6)).select("a", "b", "jw", F.when(F.col("jw") >= 0.9, 2).when(F.col("jw") >= 0.7, 1).otherwise(0).alias("level"))
