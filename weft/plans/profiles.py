"""Queries that profile tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import infer
from weft.operators import profiling as P
from weft.plans.query import query
from weft.session import table

TPCH = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def unpivoted(t: str, columns: list[str]) -> str:
    """SQL of a table's cells (column, value)."""
    return " union all ".join(f"""select '{t}' as dataset, '{c}' as "column", {c}::varchar as value from {t}""" for c in columns)


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
PROFILE = r"""with c as ({cells}), v as (select dataset, "column", value, nullif(trim(value), '') as v from c),
l as (select *, length(v) as len, length(regexp_replace(v, '[^\p{L}]', '', 'g')) as alpha, length(regexp_replace(v, '[^\p{Nd}]', '', 'g')) as digit, length(regexp_replace(v, '[^ \t\n\r\f\v]', '', 'g')) as space from v)
select dataset, "column", count(*) as n, count(value) as n_nonnull, count(distinct value) as n_distinct, round(coalesce(count(distinct v)::double / nullif(count(v), 0), 0), 6) as unique_ratio,
round(coalesce(sum(alpha)::double / sum(len), 0), 6) as alpha_ratio, round(coalesce(sum(digit)::double / sum(len), 0), 6) as digit_ratio, round(coalesce(sum(space)::double / sum(len), 0), 6) as space_ratio, round(coalesce((sum(len) - sum(alpha) - sum(digit) - sum(space))::double / sum(len), 0), 6) as special_ratio,
round(avg(len), 6) as mean_length, round(stddev_pop(len), 6) as std_length, min(len)::integer as min_length, max(len)::integer as max_length from l group by 1, 2"""


def profile_sql(t: str, columns: list[str]) -> str:
    return PROFILE.replace("{cells}", unpivoted(t, columns))


@query(profile_sql("customer", CUSTOMER))
def profile_customer(spark, d):
    return P.column_profile(P.cells(table(spark, d, "customer"), "customer"))


THIRD = ["item_code", "item_name", "category_name", "brand_name", "supplier", "retail_price", "item_weight", "product_dimensions", "availability_status", "stock_level"]


@query(profile_sql("third_system_products", THIRD))
def profile_third_products(spark, d):
    return P.column_profile(P.cells(table(spark, d, "third_system_products"), "third_system_products", THIRD))


@query("".join(["""with c as (""", unpivoted("part", ["p_name", "p_brand", "p_type"]), """) select dataset, "column", length(value)::integer as length, count(*) as n from c where value is not null group by 1, 2, 3"""]))
def length_histogram(spark, d):
    return P.length_histogram(P.cells(table(spark, d, "part"), "part", ["p_name", "p_brand", "p_type"]))


SHAPE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '\p{Nd}', chr(1), 'g'), '\p{L}', 'L', 'g'), '[^\x01L\-_. @+()/:;,|#$%&=?]', 'S', 'g'), '\x01', 'D', 'g')"
GROUPS = ["item_weight", "product_dimensions", "retail_price", "brand_name"]


@query(r"""with c as ({cells}), s as (select dataset, "column", {shape} as s from c where value is not null and value <> ''),
k as (select *, length(s) - length(replace(s, 'D', '')) as d, length(s) - length(replace(s, 'L', '')) as l, length(s) - length(replace(s, 'S', '')) as o, length(s) as n from s),
g as (select dataset, "column", 'len' || n || '_D' || d || '_L' || l || '_S' || o || '_sep' || (n - d - l - o) as group_key, count(*) as n from k group by 1, 2, 3),
f as (select *, n::double / sum(n) over (partition by dataset, "column") as f from g),
r as (select *, row_number() over w as rank, coalesce(sum(f) over (partition by dataset, "column" order by n desc, group_key rows between unbounded preceding and 1 preceding), 0) as before from f where f >= 0.01 window w as (partition by dataset, "column" order by n desc, group_key))
select dataset, "column", group_key, n, round(f, 6) as frequency, rank::integer as rank from r where before < 0.9 and rank <= 5""".replace("{cells}", unpivoted("third_system_products", GROUPS)).replace("{shape}", SHAPE))
def pattern_groups(spark, d):
    return P.pattern_groups(P.cells(table(spark, d, "third_system_products"), "third_system_products", GROUPS))


@query(r"""with c as ({cells}), s as (select dataset, "column", length(value) as len, {shape} as s from c where value is not null and value <> '')
select dataset, "column", count(*) as total_values, count(distinct s) as unique_patterns, round(avg(len), 6) as mean, median(len) as median, round(stddev_pop(len), 6) as std, min(len)::integer as min, max(len)::integer as max from s group by 1, 2""".replace("{cells}", unpivoted("third_system_products", GROUPS)).replace("{shape}", SHAPE))
def pattern_lengths(spark, d):
    return P.pattern_lengths(P.cells(table(spark, d, "third_system_products"), "third_system_products", GROUPS))


PHONE = "regexp_matches(regexp_replace(v, '[-() ]', '', 'g'), '^[0-9]{7,15}$')"
CODE = r"(length(v) between 5 and 20 and regexp_matches(v, '^[\p{L}\p{Nd}_-]+$') and ((length(regexp_replace(v, '[^\p{Nd}]', '', 'g')) > 0.7 * length(v) and regexp_matches(lower(v), 'id|no|num|ref|code')) or (regexp_matches(v, '\p{L}') and regexp_matches(v, '\p{Nd}'))))"


@query(f"""with v as (select distinct c_name as v from customer union select distinct c_custkey::varchar from customer union select distinct product_dimensions from third_system_products where product_dimensions is not null union select distinct product_sku from cluster_2_unified where product_sku is not null)
select v, {PHONE} as phone_like, {CODE} as id_like from v""")
def value_kinds(spark, d):
    v = table(spark, d, "customer").select(F.col("c_name").alias("v")).union(table(spark, d, "customer").select(F.col("c_custkey").cast("string")))
    v = v.union(table(spark, d, "third_system_products").select("product_dimensions")).union(table(spark, d, "cluster_2_unified").select("product_sku")).where("v is not null").distinct()
    return v.select("v", infer.is_phone(F.col("v")).alias("phone_like"), infer.is_code(F.col("v")).alias("id_like"))


@query(r"""with v as (select distinct strftime(o_orderdate, '%d/%m/%Y') as v from orders union select distinct strftime(o_orderdate, '%Y.%m.%d') from orders union select distinct p_name from part)
select v, regexp_matches(v, '^[0-9]{2}/[0-9]{2}/[0-9]{4}$') or (regexp_matches(v, '^[0-9]{4}[.][0-9]{2}[.][0-9]{2}$') and try_cast(right(v, 2) as integer) <= 12) as date_like from v""")
def date_like(spark, d):
    o = table(spark, d, "orders")
    v = o.select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("v")).union(o.select(F.date_format("o_orderdate", "yyyy.MM.dd"))).union(table(spark, d, "part").select("p_name")).distinct()
    return v.select("v", infer.date_like(F.col("v")).alias("date_like"))


# The year-first order takes the last part for the month.
# Integers of four digits are not counted as integers, ISO dates count as phone numbers once "-" is gone.
TYPES = r"""with c as ({cells}), v as (select dataset, "column", value, nullif(trim(value), '') as v from c),
f as (select *, {phone} as phone, {code} as code, regexp_matches(v, '^[+-]?[0-9]+$') and not try_cast(v as hugeint) between 1000 and 9999 as i, regexp_matches(v, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') as n, lower(v) in ('true', 'false', 'yes', 'no', '0', '1', 't', 'f', 'y', 'n') as b from v)
select dataset, "column", case when count(value) = 0 then 'unknown' when count(v) = 0 then 'string' when avg(b::int) = 1 then 'boolean' when avg(phone::int) > 0.8 then 'string' when avg(i::int) > 0.9 then 'integer' when avg(n::int) > 0.9 then 'float' else 'string' end as type from f group by 1, 2"""
TYPED = [("customer", CUSTOMER), ("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]), ("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("region", ["r_regionkey", "r_name"]), ("third_system_products", ["item_code", "item_name", "retail_price", "stock_level", "availability_status"])]


@query(TYPES.replace("{cells}", " union all ".join(unpivoted(t, c) for t, c in TYPED)).replace("{phone}", PHONE).replace("{code}", CODE))
def infer_types(spark, d):
    out = None
    for t, c in TYPED:
        x = P.cells(table(spark, d, t), t, c)
        out = x if out is None else out.unionByName(x)
    return P.inferred_types(out)


@query()
def infer_types_all(spark, d):
    """Types of all columns of all relational tables, with the simple rules (any date makes a date column)."""
    return P.inferred_types(P.all_cells({t: table(spark, d, t) for t in TPCH}), simple=True)


@query(r"""with v as (select distinct retail_price as v from third_system_products where retail_price is not null union select distinct c_custkey::varchar from customer union select distinct p_name from part union select distinct c_acctbal::varchar from customer),
t as (select v, regexp_replace(trim(v), '^\$|%$', '') as x from v)
select v, case when regexp_matches(x, '^[-+]?([0-9]{1,3}(,[0-9]{3})*|[0-9]+)$') then 'integer' when regexp_matches(x, '^[-+]?[0-9]*[.][0-9]+$') then 'decimal' else 'text' end as type from t""")
def annotate_types(spark, d):
    c = table(spark, d, "customer")
    v = table(spark, d, "third_system_products").select(F.col("retail_price").alias("v")).union(c.select(F.col("c_custkey").cast("string"))).union(table(spark, d, "part").select("p_name")).union(c.select(F.col("c_acctbal").cast("string"))).where("v is not null").distinct()
    return v.select("v", infer.annotated_type(F.col("v")).alias("type"))


# Formats of the type annotator as date_format and as strftime write them.
WRITTEN = [("EEEE, MM/dd/yyyy", "%A, %m/%d/%Y"), ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"), ("yyyy-MM-dd'T'HH:mm:ss.SSS", "%Y-%m-%dT%H:%M:%S.%g"), ("yyyy-MM-dd", "%Y-%m-%d"), ("MM/dd/yyyy HH:mm:ss", "%m/%d/%Y %H:%M:%S"), ("MM/dd/yyyy", "%m/%d/%Y"), ("dd/MM/yyyy", "%d/%m/%Y"), ("MM/dd/yy", "%m/%d/%y"), ("dd/MM/yy", "%d/%m/%y"), ("dd-MMM-yy", "%d-%b-%y"), ("MMM-dd", "%b-%d"), ("dd-MMM", "%d-%b")]


def _written(form: str, sql: str) -> str:
    day = "case when strftime(o_orderdate, '%m-%d') = '02-29' then 'text' else 'date' end" if form in ("MMM-dd", "dd-MMM") else "'date'"
    return f"select '{form.replace("'", "''")}' as form, strftime(o_orderdate, '{sql}') as v, {day} as type, count(*) as n from orders where o_orderdate is not null group by 1, 2, 3"


@query(" union all ".join(_written(*w) for w in WRITTEN) + " union all select 'geo', '(' || c_acctbal || ', ' || c_custkey || ')', 'geo', count(*) from customer where c_acctbal is not null and c_custkey is not null group by 1, 2, 3 union all select 'none', strftime(o_orderdate, '%d.%m.%Y'), 'text', count(*) from orders where o_orderdate is not null group by 1, 2, 3")
def annotate_dates(spark, d):
    """The type of every order date written in each of the annotator's formats, of points and of dates in another format."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    v = o.select(F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.date_format("o_orderdate", f).alias("v")) for f, _ in [*WRITTEN, ("dd.MM.yyyy", "")]])).alias("x")).select(F.when(F.col("x.form") == "dd.MM.yyyy", "none").otherwise(F.col("x.form")).alias("form"), "x.v")
    v = v.unionByName(c.select(F.lit("geo").alias("form"), F.concat(F.lit("("), F.col("c_acctbal").cast("string"), F.lit(", "), F.col("c_custkey").cast("string"), F.lit(")")).alias("v"))).where("v is not null")
    n = v.groupBy("form", "v").agg(F.count(F.lit(1)).alias("n"))
    return n.select("form", "v", infer.annotated_type(F.col("v")).alias("type"), "n")


@query(r"""with c as ({cells}), t as (select dataset, "column", case when regexp_matches(trim(value), '^[-+]?[0-9]+$') then 'integer' when regexp_matches(trim(value), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') then 'decimal' else 'text' end as type from c where value is not null)
select dataset, "column", type, count(*) as n from t group by 1, 2, 3""".replace("{cells}", " union all ".join(unpivoted(t, c) for t, c in TYPED)))
def type_histogram(spark, d):
    out = None
    for t, c in TYPED:
        x = P.cells(table(spark, d, t), t, c)
        out = x if out is None else out.unionByName(x)
    return out.where("value is not null").groupBy("dataset", "column", infer.plain_type(F.col("value")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("""with r as (select "column", value, row_number() over (partition by "column" order by o) as position from (select o_orderkey as o, 'o_orderpriority' as "column", o_orderpriority as value from orders where o_orderpriority is not null union all select o_orderkey, 'o_orderstatus', o_orderstatus from orders where o_orderstatus is not null))
select "column", position::integer as position, value from r where position <= 20""")
def sample_values(spark, d):
    return P.samples(table(spark, d, "orders"), "o_orderkey", ["o_orderpriority", "o_orderstatus"])


M = ["asin", "title", "category", "subcategory", "seller", "brand", "current_price", "weight_kg", "specifications", "stock_quantity", "product_condition"]


@query(f"""with k as (select {', '.join(M)}, count(*) as n from modern_products group by all)
select 'modern_products' as dataset, sum(n)::bigint as rows, {len(M)} as columns, round(({' + '.join(f'coalesce(sum(n) filter ({c} is null), 0)' for c in M)})::double / (sum(n) * {len(M)}), 6) as missing_share, (sum(n) - count(*))::bigint as duplicate_rows, ({' + '.join(f'(coalesce(sum(n) filter ({c} is null), 0) > 0.5 * sum(n))::integer' for c in M)})::integer as half_empty_columns from k""")
def structure_report(spark, d):
    return P.structure_report(table(spark, d, "modern_products").select(*M), "modern_products")


MN = [c for c in M if c in ("current_price", "weight_kg", "stock_quantity")]


def _quality(c: str) -> str:
    num = c in MN
    blanks = "0::bigint" if num else f"(count(*) filter (trim({c}) = '') + count(*) filter ({c} = ''))::bigint"
    zeros = f"count(*) filter ({c} = 0)" if num else "0::bigint"
    return f"""select 'modern_products' as dataset, '{c}' as "column", count(*) filter ({c} is null) as nulls, count(distinct {c}) as "distinct", {blanks} as blanks, {zeros} as zeros, {f'count(*) filter ({c} < 0)' if num else '0::bigint'} as negatives, {zeros} > 0.5 * count(*) as mostly_zero from modern_products"""


@query(" union all ".join(_quality(c) for c in M))
def quality_report(spark, d):
    return P.quality_report(table(spark, d, "modern_products").select(*M), "modern_products")


@query("""select 'o_orderkey' as "column", round(count(distinct o_orderkey)::double / count(*), 6) as unique_ratio from orders having count(distinct o_orderkey) > 0.95 * count(*)
union all select 'o_custkey', round(count(distinct o_custkey)::double / count(*), 6) from orders having count(distinct o_custkey) > 0.95 * count(*)
union all select 'o_totalprice', round(count(distinct o_totalprice)::double / count(*), 6) from orders having count(distinct o_totalprice) > 0.95 * count(*)
union all select 'o_orderdate', round(count(distinct o_orderdate)::double / count(*), 6) from orders having count(distinct o_orderdate) > 0.95 * count(*)""")
def candidate_keys(spark, d):
    return P.candidate_keys(table(spark, d, "orders"))


def _assess(c: str, dtype: str, temporal: bool, key: str) -> str:
    return f"""select 'supplier' as dataset, '{c}' as "column", '{dtype}' as dtype, round(100.0 * count(*) filter ({c} is null) / count(*), 6)::double as null_percent, count(distinct {c}) as n_unique, {temporal} as temporal, {key} as candidate_key from supplier"""


@query(" union all ".join([_assess("s_suppkey", "bigint", False, "count(distinct s_suppkey) > 0.95 * count(*)"), _assess("s_name", "string", False, "false"), _assess("s_nationkey", "int", False, "count(distinct s_nationkey) > 0.95 * count(*)"), _assess("s_acctbal", "double", False, "count(distinct s_acctbal) > 0.95 * count(*)")]))
def file_assessment(spark, d):
    return P.assessment(table(spark, d, "supplier"), "supplier")


@query()
def column_overlap_files(spark, d):
    """Mean-free pairwise Jaccard of column names of the product tables."""
    return P.column_overlap({t: table(spark, d, t) for t in ("modern_products", "third_system_products", "cluster_2_unified", "deduplicated_output")})


@query()
def schema_overview(spark, d):
    """Columns and types of all relational tables."""
    return P.schema_overview({t: table(spark, d, t) for t in TPCH})


@query("""with m as (select min(c_acctbal) as lo, (max(c_acctbal) - min(c_acctbal)) / 20 as w from customer) select least(20, floor((c_acctbal - lo) / w) + 1)::integer as bucket, count(*) as n from customer, m group by 1""")
def equal_width_histogram(spark, d):
    return P.bucket_histogram(table(spark, d, "customer"), "c_acctbal", 20)


@query(" union all ".join(f"""select '{t}' as dataset, '{c}' as "column", count({c}) as total, count(distinct {c}) as "distinct" from {t}""" for t, c in (("customer", "c_name"), ("customer", "c_mktsegment"), ("part", "p_name"), ("part", "p_type"))))
def column_sizes(spark, d):
    out = P.cells(table(spark, d, "customer"), "customer", ["c_name", "c_mktsegment"]).unionByName(P.cells(table(spark, d, "part"), "part", ["p_name", "p_type"]))
    return P.counted(out).groupBy("dataset", "column").agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("total"), F.count("value").alias("distinct"))


@query("""select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n, count(*) filter (value is null) as nulls, min(value) as least, max(value) as most, round(sum(value), 4) as total from events group by 1, 2""")
def windowed_events(spark, d):
    """Daily profile of the events: the batch form of the streaming profile."""
    from weft.streaming.incremental import windowed

    return windowed(table(spark, d, "events"))
