"""Queries of the remaining profiling, mapping and discovery operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import infer, text
from weft.operators import domains as D
from weft.operators import mapping as X
from weft.operators import profiling as P
from weft.plans.discovery import classes
from weft.plans.profiles import unpivoted
from weft.plans.query import query
from weft.plans.schemas import OTHERS, PRODUCTS, columns, profiled
from weft.session import cut, table

THIRD = ["item_code", "item_name", "brand_name", "retail_price", "item_weight", "stock_level"]
NUM = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


@query(rf"""with c as ({unpivoted('third_system_products', THIRD)}), v as (select "column", value, regexp_matches(trim(regexp_replace(value, '[,$]', '', 'g')), '{NUM}') as num, regexp_matches(upper(value), '^(PROD|ITEM|ASIN|SKU|CUST|ORD|B0)') as idp, regexp_matches(value, '[{{].*[}}]') as js from c where value is not null)
select "column", case when avg(num::int) > 0.8 then 'numeric' else 'text' end as type, avg(idp::int) > 0.5 or count(distinct value) > 0.95 * count(*) as is_id, avg(js::int) > 0.3 as is_json from v group by 1""")
def dedup_types(spark, d):
    """Numeric or text, identifier, JSON: by all values of a column, not its first hundred."""
    c = P.counted(P.cells(table(spark, d, "third_system_products"), "t", THIRD)).where("value is not null")
    n, v = F.col("n"), F.col("value")
    share = lambda cond: F.sum(F.when(cond, n).otherwise(0)) / F.sum("n")
    num = F.trim(F.regexp_replace(v, "[,$]", "")).rlike(NUM)
    return c.groupBy("column").agg(F.when(share(num) > 0.8, "numeric").otherwise("text").alias("type"), ((share(F.upper(v).rlike("^(PROD|ITEM|ASIN|SKU|CUST|ORD|B0)")) > 0.5) | (F.count(F.lit(1)) > 0.95 * F.sum("n"))).alias("is_id"), (share(v.rlike("[{].*[}]")) > 0.3).alias("is_json"))


@query("""select 'modern_products' as dataset, 'asin' as "column", case when min(asin) like 'B0%' and length(min(asin)) = 10 then 'ASIN (B0########)' else 'Unknown' end as format, count(distinct asin) as n_unique from modern_products
union all select 'third_system_products', 'item_code', case when min(item_code) like 'ITEM-%' then 'ITEM-####' else 'Unknown' end, count(distinct item_code) from third_system_products""")
def identifier_report(spark, d):
    out = None
    for t, c in (("modern_products", "asin"), ("third_system_products", "item_code")):
        x = table(spark, d, t).groupBy().agg(infer.id_format(F.min(c)).alias("format"), F.countDistinct(c).alias("n_unique")).select(F.lit(t).alias("dataset"), F.lit(c).alias("column"), "format", "n_unique")
        out = x if out is None else out.unionByName(x)
    return out


@query()
def date_patterns(spark, d):
    """Which separators make dates in which columns."""
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("slashed"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), F.date_format("o_orderdate", "d.M.yyyy").alias("dotted"))
    c = P.counted(P.cells(o, "orders")).where(infer.date_like(F.col("value")))
    kind = F.when(F.col("value").contains("T"), "iso_timestamp").otherwise(F.concat(F.lit("digit"), F.regexp_extract("value", "([-/. ])", 1), F.lit("digit"), F.regexp_extract("value", "([-/. ])", 1), F.lit("digit")))
    return c.groupBy("column", kind.alias("pattern")).agg(F.sum("n").alias("n"))


@query("""with a as (select brand as k, count(*)::double / sum(count(*)) over () as p from modern_products where brand is not null group by 1), b as (select brand_name as k, count(*)::double / sum(count(*)) over () as q from third_system_products where brand_name is not null group by 1),
j as (select coalesce(p, 0) + 1e-10 as p, coalesce(q, 0) + 1e-10 as q, (coalesce(p, 0) + coalesce(q, 0)) / 2 + 1e-10 as m from a full join b using (k)), n as (select sum(p) as sp, sum(q) as sq, sum(m) as sm from j)
select round(1 - (sum(p / sp * ln((p / sp) / (m / sm))) + sum(q / sq * ln((q / sq) / (m / sm)))) / 2 / ln(2), 6) as similarity from j, n""")
def token_similarity(spark, d):
    """Smoothed Jensen-Shannon similarity of the brand spellings of two systems."""
    a = table(spark, d, "modern_products").where("brand is not null").groupBy(F.col("brand").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = table(spark, d, "third_system_products").where("brand_name is not null").groupBy(F.col("brand_name").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    j = cut(a.join(b, "k", "full").na.fill(0, ["a", "b"]))
    na, nb = j.agg(F.sum("a"), F.sum("b")).first()
    e = 1e-10
    j = j.select((F.col("a") / float(na or 1) + e).alias("p"), (F.col("b") / float(nb or 1) + e).alias("q"), ((F.col("a") / float(na or 1) + F.col("b") / float(nb or 1)) / 2 + e).alias("m"))
    sp, sq, sm = j.agg(F.sum("p"), F.sum("q"), F.sum("m")).first()
    p, q, m = F.col("p") / float(sp or 1), F.col("q") / float(sq or 1), F.col("m") / float(sm or 1)
    return j.agg(F.round(1 - (F.sum(p * F.log(p / m)) + F.sum(q * F.log(q / m))) / 2 / F.log(F.lit(2.0)), 6).alias("similarity"))


@query()
def data_driven_mapping(spark, d):
    """Reciprocal best columns by name, type, pattern and common values."""
    names = ["modern_products", "third_system_products", "cluster_2_unified"]
    v = P.counted(P.all_cells({n: table(spark, d, n) for n in names})).where("value is not null")
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("dataset", "column").orderBy(F.desc("n"), "value"))
    s = v.withColumn("k", k).where("k <= 5").groupBy("dataset", "column").agg(F.collect_list("value").alias("values"))
    return X.data_driven(profiled(spark, d, names), s)


@query()
def closest_columns(spark, d):
    return X.closest(columns(spark, d, [*PRODUCTS, *OTHERS]))


@query()
def column_clusters(spark, d):
    c = X.column_clusters(profiled(spark, d, list(PRODUCTS)))
    return spark.createDataFrame([(i, X.golden_name([n.split(".")[1] for n in p]), n) for i, p in enumerate(c) for n in p], "cluster_id int, golden_name string, column string")


@query()
def dominant_names(spark, d):
    return X.dominant_names(columns(spark, d, [*PRODUCTS, *OTHERS]))


@query("""select round(percentile_cont(0.75) within group (order by length(title)), 6)::double as q75, round(avg(length(title)), 6) as mean, round(stddev_pop(length(title)), 6) as std from modern_products where title is not null""")
def learned_thresholds(spark, d):
    """Mean, deviation and upper quartile of a ratio, as thresholds for later tables."""
    t = table(spark, d, "modern_products").where("title is not null").select(F.length("title").alias("n"))
    return t.agg(F.round(F.percentile("n", 0.75), 6).alias("q75"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"))


@query("""select event_id, (props::json ->> 'k') as k from events""")
def json_members(spark, d):
    """A member of a JSON cell."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""with t as (select distinct p_type as v from part) select v, regexp_matches(v, '^[0-9]+$') as digits_only, regexp_matches(v, '^[A-Za-z]+$') as letters_only, least(v, reverse(v)) || chr(1) || greatest(v, reverse(v)) as pair_key from t""")
def string_helpers(spark, d):
    v = table(spark, d, "part").select(F.col("p_type").alias("v")).distinct()
    return v.select("v", F.col("v").rlike("^[0-9]+$").alias("digits_only"), F.col("v").rlike("^[A-Za-z]+$").alias("letters_only"), text.pair_key(F.col("v"), F.reverse("v")).alias("pair_key"))


@query()
def one_column_domains(spark, d):
    """Local domains of one column only: the interactive form."""
    c, _ = classes(spark, d)
    c = cut(c)
    s = cut(D.robust(cut(D.blocks(D.similarities(c, "JI"))), c))
    e = D.expand(s, c)
    return D.local_domains(e.where("column_id = 0"), s, c)


@query()
def domain_statistics(spark, d):
    """Numbers of classes and terms of every class's robust signature."""
    c, _ = classes(spark, d)
    c = cut(c)
    s = D.robust(cut(D.blocks(D.similarities(c, "TF-ICF"), ignore_minor=False)), c, "IGNORE-LAST")
    return s.join(c.select(F.col("eq").alias("other"), "n_terms"), "other").groupBy("eq").agg(F.countDistinct("block_no").alias("blocks"), F.count(F.lit(1)).alias("classes"), F.sum("n_terms").alias("terms"), F.round(F.avg("sim"), 6).alias("mean_sim"))


@query("""with p as (select p_partkey % 7 as g, p_brand as v from part), a as (select g, list(distinct v) as s from p group by 1) select a.g as a, b.g as b, len(list_intersect(a.s, b.s))::integer as common, len(list_distinct(a.s || b.s))::integer as either, len(list_filter(a.s, lambda x: not list_contains(b.s, x)))::integer as only_a from a a join a b on a.g < b.g""")
def id_set_operations(spark, d):
    """Union, intersection and difference of sets as arrays of a bounded vocabulary."""
    a = table(spark, d, "part").select((F.col("p_partkey") % 7).alias("g"), "p_brand").distinct().groupBy("g").agg(F.collect_set("p_brand").alias("s"))
    p = a.selectExpr("g a", "s sa", "1 o").join(a.selectExpr("g b", "s sb", "1 o"), "o").where("a < b")
    return p.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), F.size(F.array_union("sa", "sb")).alias("either"), F.size(F.array_except("sa", "sb")).alias("only_a"))


@query()
def bounded_similarity(spark, d):
    """All pairs of category spellings of a Levenshtein similarity of at least 0.8."""
    from weft.operators.pairs import similar_strings

    return similar_strings(table(spark, d, "modern_products").select(F.lower(F.trim("category")).alias("v")), 0.8)
