"""Queries of scalar functions and string comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import infer, metrics, text
from weft.operators import pairs
from weft.plans.query import query
from weft.session import cut, table

WS = r"[ \t\n\r\f\v]+"


@query(rf"""select row_no, case when title is null then '' else lower(trim(regexp_replace(title, '{WS}', ' ', 'g'))) end as clean from modern_products""")
def clean_text_titles(spark, d):
    return table(spark, d, "modern_products").select("row_no", text.clean_text(F.col("title")).alias("clean"))


@query("""select event_id, '' as clean from events""")
def clean_text_json(spark, d):
    return table(spark, d, "events").select("event_id", text.clean_text(F.col("props")).alias("clean"))


@query(rf"""select p_partkey, trim(regexp_replace(upper(p_name), '{WS}', ' ', 'g')) as term from part""")
def normalize_terms_part(spark, d):
    return table(spark, d, "part").select("p_partkey", text.term(F.col("p_name")).alias("term"))


@query(r"""with s as (select row_no, trim(regexp_replace(item_weight, '[$,%€£¥]', '', 'g')) as v from third_system_products)
select row_no, try_cast(nullif(regexp_extract(v, '([-+]?[0-9]*[.]?[0-9]+(?:[eE][-+]?[0-9]+)?)', 1), '') as double) as amount from s""")
def extract_number_weights(spark, d):
    return table(spark, d, "third_system_products").select("row_no", text.extract_number(F.col("item_weight")).alias("amount"))


@query(r"""select event_id, try_cast(nullif(regexp_extract(props, '([-+]?[0-9]*[.]?[0-9]+)', 1), '') as double) as amount from events""")
def extract_number_events(spark, d):
    return table(spark, d, "events").select("event_id", text.extract_number(F.col("props")).alias("amount"))


@query(rf"""select row_no, case when product_name is null then '' else trim(regexp_replace(regexp_replace(regexp_replace(lower(product_name), '[-_./]', ' ', 'g'), '[^a-z0-9 \t\n\r\f\v]', '', 'g'), '{WS}', ' ', 'g')) end as tokens from cluster_2_unified""")
def token_clean_products(spark, d):
    return table(spark, d, "cluster_2_unified").select("row_no", text.clean_tokens(F.col("product_name")).alias("tokens"))


PARTS = "n as (select distinct p_name as v from part), p as (select a.v as a, b.v as b from n a join n b on a.v < b.v)"


@query(f"""with {PARTS}, s as (select a, b, 1 - levenshtein(a, b)::double / greatest(length(a), length(b)) as sim from p) select a, b, round(sim, 6) as sim from s where sim >= 0.6""")
def levenshtein_parts(spark, d):
    return pairs.similar_strings(table(spark, d, "part").select(F.col("p_name").alias("v")), 0.6)


@query(f"""with {PARTS}, w as (select v, string_split(v, ' ') as t from n), s as (select a, b, len(list_intersect(x.t, y.t))::double / len(list_distinct(x.t || y.t)) as sim from p join w x on x.v = a join w y on y.v = b) select a, b, round(sim, 6) as sim from s where sim > 0""")
def token_jaccard_parts(spark, d):
    return pairs.token_pairs(table(spark, d, "part").select(F.col("p_name").alias("v"))).select("a", "b", F.round("sim", 6).alias("sim"))


JW = "least(1.0, jaro_similarity(a, b) + 0.1 * (case when left(a,1) <> left(b,1) then 0 when left(a,2) <> left(b,2) then 1 when left(a,3) <> left(b,3) then 2 when left(a,4) <> left(b,4) then 3 else 4 end) * (1 - jaro_similarity(a, b)))"


@query(f"""with {PARTS} select a, b, round({JW}, 6) as sim from p where string_split(a, ' ')[1] = string_split(b, ' ')[1]""")
def jaro_winkler_parts(spark, d):
    return pairs.block_pairs(table(spark, d, "part").select(F.col("p_name").alias("v")).distinct(), "v", F.split("v", " ")[0]).select("a", "b", F.round(metrics.jaro_winkler("a", "b"), 6).alias("sim"))


@query(f"""with {PARTS}, w as (select v, string_split(v, ' ') as t from n), s as (select a, b, {JW} as jw, len(list_intersect(x.t, y.t))::double / len(list_distinct(x.t || y.t)) as tj from p join w x on x.v = a join w y on y.v = b where x.t[1] = y.t[1]) select a, b, round(greatest(jw, tj), 6) as sim from s""")
def text_similarity_parts(spark, d):
    p = pairs.block_pairs(table(spark, d, "part").select(F.col("p_name").alias("v")).distinct(), "v", F.split("v", " ")[0])
    return p.select("a", "b", F.round(metrics.text_similarity(F.col("a"), F.col("b"), F.split("a", " "), F.split("b", " ")), 6).alias("sim"))


@query()
def difflib_brands(spark, d):
    """Ratcliff-Obershelp ratio of all pairs of brand spellings."""
    v = table(spark, d, "third_system_products").select(F.trim(F.lower("brand_name")).alias("v")).where("v <> ''")
    return pairs.every_pair(v).select("a", "b", F.round(metrics.difflib_ratio("a", "b"), 6).alias("sim"))


@query(f"""with {PARTS}, s as (select a, b, levenshtein(a, b) as d from p) select count(*) filter (where d <= 3) as within_3, count(*) filter (where d <= 6) as within_6, max(d)::bigint as farthest from s""")
def bounded_levenshtein_parts(spark, d):
    v = table(spark, d, "part").select(F.col("p_name").alias("v"))
    p = pairs.every_pair(v).withColumn("d", F.levenshtein("a", "b"))
    near = lambda k: F.sum((F.levenshtein("a", "b", k) >= 0).cast("long"))
    return p.agg(near(3).alias("within_3"), near(6).alias("within_6"), F.max("d").cast("long").alias("farthest"))


@query("""select item_code, brand_name, case when brand_name is null then null else regexp_replace(regexp_replace(regexp_replace(regexp_replace(brand_name, '\\p{Nd}', chr(1), 'g'), '\\p{L}', 'L', 'g'), '[^\\x01L\\-_. @+()/:;,|#$%&=?]', 'S', 'g'), '\\x01', 'D', 'g') end as shape from (select distinct item_code, brand_name from third_system_products)""".replace("\\\\", "\\"))
def value_shapes_brands(spark, d):
    return table(spark, d, "third_system_products").select("item_code", "brand_name").distinct().select("item_code", "brand_name", text.value_shape(F.col("brand_name")).alias("shape"))


@query(r"""with c as (select distinct p_brand as v from part union select distinct p_type from part union select distinct p_name from part), s as (select v, unnest(generate_series(1, length(v))) as i from c),
k as (select v, i, case when regexp_matches(substr(v, i, 1), '\p{L}') then 'L' when regexp_matches(substr(v, i, 1), '\p{Nd}') then 'D' when substr(v, i, 1) in ('_', '-', '.') then 'S' else 'O' end as c from s),
g as (select v, i, c, i - row_number() over (partition by v, c order by i) as r from k),
e as (select v, c, min(i) as i, count(*) as n from g group by v, c, r)
select v, string_agg(c || case when n > 1 then n::varchar else '' end, '' order by i) as pattern from e group by v""")
def char_run_patterns(spark, d):
    p = table(spark, d, "part")
    v = p.select(F.col("p_brand").alias("v")).union(p.select("p_type")).union(p.select("p_name")).distinct()
    return v.select("v", text.run_pattern(F.col("v")).alias("pattern"))


@query(r"""with f as (select distinct file_name as f from feed_records), t as (select f, list_filter(regexp_split_to_array(lower(regexp_replace(f, '\.[^.]*$', '')), '[_\-. ]+'), lambda x: x <> '') as t from f)
select f as file_name, t[1] as prefix, case when len(t) > 1 then t[-1] end as suffix, len(t)::integer as parts from t""")
def filename_parts(spark, d):
    f = table(spark, d, "feed_records").select("file_name").distinct()
    return f.select("file_name", text.name_prefix(F.col("file_name")).alias("prefix"), text.name_suffix(F.col("file_name")).alias("suffix"), F.size(text.name_tokens(text.stem(F.col("file_name")))).alias("parts"))


@query(r"""with v as (select distinct category as v from modern_products where category is not null), w as (select v, list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(v), '[_-]', ' ', 'g'), ' +'), lambda x: x <> ''))) as l from v)
select v, array_to_string(l, ' ') as words from w""")
def sorted_words_categories(spark, d):
    v = table(spark, d, "modern_products").select(F.col("category").alias("v")).where("v is not null").distinct()
    return v.select("v", text.sorted_words(F.col("v")).alias("words"))


@query("""select distinct asin as v, case when asin like 'B0%' and length(asin) = 10 then 'ASIN (B0########)' when asin like 'ITEM-%' then 'ITEM-####' else 'Unknown' end as format from modern_products
union select distinct product_sku, case when product_sku is null or trim(product_sku) = '' then 'Empty' when product_sku like 'PROD-%' then 'PROD-A###' when product_sku like 'ITEM-%' then 'ITEM-####' when product_sku like 'B0%' and length(product_sku) = 10 then 'ASIN (B0########)' else 'Unknown' end from cluster_2_unified""")
def identifier_formats(spark, d):
    v = table(spark, d, "modern_products").select(F.col("asin").alias("v")).union(table(spark, d, "cluster_2_unified").select("product_sku")).distinct()
    return v.select("v", infer.id_format(F.col("v")).alias("format"))


@query("""with a as (select p_type as k, count(*)::double / sum(count(*)) over () as p from part where p_size <= 25 group by 1), b as (select p_type as k, count(*)::double / sum(count(*)) over () as q from part where p_size > 25 group by 1),
j as (select coalesce(p, 0) as p, coalesce(q, 0) as q from a full join b using (k))
select round(sum((case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) / 2), 6) as jsd from j""")
def jensen_shannon_parts(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("k"), (F.col("p_size") <= 25).alias("low"))
    n = p.groupBy("k").agg(F.sum(F.col("low").cast("long")).alias("a"), F.sum((~F.col("low")).cast("long")).alias("b"))
    t = n.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return n.join(F.broadcast(t)).agg(F.round(F.sum(metrics.jensen_shannon(F.col("a") / F.col("ta"), F.col("b") / F.col("tb"))), 6).alias("jsd"))


@query()
def encoder_similarity_columns(spark, d):
    """Cosine of hashed trigram vectors of all pairs of category spellings that share a word: the offline stand-in for sentence vectors."""
    v = table(spark, d, "canonical_values").where("kind = 'category'").select(F.col("canonical_name").alias("v"))
    v = cut(v.withColumn("e", metrics.hashed_vector("v")))
    p = pairs.every_pair(v.select("v")).join(v.selectExpr("v a", "e ea"), "a").join(v.selectExpr("v b", "e eb"), "b")
    return p.select("a", "b", F.round(metrics.cosine(F.col("ea"), F.col("eb")), 6).alias("sim"))
