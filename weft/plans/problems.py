"""Queries of the general problems that SQL can say, beside those of the operators' modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import drift, quality
from weft.plans.query import SQL, query
from weft.session import table


@query("""with r as (select feed_id, file_no, k.key as name, case k.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then null else 'number' end as kind from feed_records, json_each(payload) k),
c as (select feed_id, file_no, name, kind, count(*) as n from r group by all), b as (select feed_id, file_no, name, sum(n)::bigint as bearers from c group by all),
t as (select feed_id, file_no, name, kind, row_number() over (partition by feed_id, file_no, name order by n desc, kind) as k from c where kind is not null)
select b.feed_id, b.file_no, b.name, t.kind, b.bearers from b left join t on b.feed_id = t.feed_id and b.file_no = t.file_no and b.name = t.name and t.k = 1""")
def p2_schemas(spark, d):
    """The schema of every delivered file."""
    return drift.schemas(drift.fields(table(spark, d, "feed_records")))


NUMBERS = """v as (select 'current_price' as column_name, load_no, current_price as x from modern_products union all select 'stock_quantity', load_no, stock_quantity from modern_products),
n as (select column_name, load_no, count(*) as rows, count(*) filter (x is null)::double / count(*) as null_share, count(*) filter (x < 0)::double / count(x) as negative_share, count(*) filter (x = 0)::double / count(x) as zero_share, count(distinct x) as distinct_values, quantile_disc(x, 0.25)::double as q25, quantile_disc(x, 0.5)::double as q50, quantile_disc(x, 0.75)::double as q75, count(x) as m from v group by 1, 2),
t as (select column_name, load_no, max(c) as top from (select column_name, load_no, x, count(*) as c from v where x is not null group by all) group by 1, 2),
g as (select n.column_name, n.load_no, n.m, p.x from n join (select distinct column_name, x from v where x is not null) p using (column_name)),
k as (select column_name, load_no, x, count(*) as c from v where x is not null group by all),
f as (select g.column_name, g.load_no, g.x, coalesce(sum(c) over (partition by g.column_name, g.load_no order by g.x), 0) / g.m as f from g left join k using (column_name, load_no, x)),
d as (select a.column_name, a.load_no, b.load_no as other, max(abs(a.f - b.f)) as d from f a join f b on a.column_name = b.column_name and a.x = b.x and a.load_no <> b.load_no group by all),
s as (select column_name, load_no, median(d) as ks from d group by 1, 2)"""


@query(f"""with {NUMBERS} select 'modern_products' as table_name, column_name, load_no, rows, round(null_share, 6) as null_share, round(negative_share, 6) as negative_share, round(zero_share, 6) as zero_share, round(top::double / m, 6) as top_share, distinct_values, q25, q50, q75, round(ks, 6) as ks from n join t using (column_name, load_no) join s using (column_name, load_no)""")
def p4_numbers(spark, d):
    """Shares, exact quantiles and median Kolmogorov-Smirnov distance of the numeric columns of every load."""
    p = quality.profile(quality.unpivot(table(spark, d, "modern_products"), "modern_products", "load_no", ["current_price", "stock_quantity"]))
    return p.select("table_name", "column_name", "load_no", "rows", "null_share", "negative_share", "zero_share", "top_share", "distinct_values", "q25", "q50", "q75", F.col("ks"))


# The rule of quality._judge over all three columns, with the curves of every load against every other.
SQL["p4_found"] = r"""with v as (select 'modern_products' as t, 'current_price' as c, load_no, current_price::varchar as raw, current_price as x, false as txt from modern_products union all select 'modern_products', 'stock_quantity', load_no, stock_quantity::varchar, stock_quantity, false from modern_products
union all select 'third_system_products', 'retail_price', load_no, retail_price, try_cast(replace(nullif(regexp_extract(retail_price, '^\s*[$€£]?\s*(-?[0-9][0-9.,]*)\s*(?:[A-Za-z]{3})?\s*$', 1), ''), ',', '.') as double), true from third_system_products),
s as (select *, case when txt and raw is not null then substr(regexp_replace(regexp_replace(raw, '[0-9]+', '9', 'g'), '\p{L}+', 'a', 'g'), 1, 24) end as shape from v where load_no is not null),
us as (select t, c, shape from (select t, c, shape, row_number() over (partition by t, c order by count(*) desc, shape desc) as k from s where shape is not null group by t, c, shape) where k = 1),
tp as (select t, c, load_no, max(n) as top from (select t, c, load_no, raw, count(*) as n from s where raw is not null group by all) group by all),
n as (select s.t, s.c, s.load_no, count(*) as rows, count(*) filter (raw is null)::double / count(*) as null_share, count(raw) as filled, count(x) as m, coalesce(count(*) filter (raw is not null and x is null)::double / nullif(count(raw), 0), 0) as unreadable, coalesce(count(*) filter (s.shape <> us.shape)::double / nullif(count(raw), 0), 0) as odd, coalesce(count(*) filter (x < 0)::double / nullif(count(raw), 0), 0) as negative, coalesce(count(*) filter (x = 0)::double / nullif(count(raw), 0), 0) as zero from s left join us on s.t = us.t and s.c = us.c group by s.t, s.c, s.load_no),
nt as (select n.*, coalesce(top::double / nullif(filled, 0), 0) as top from n left join tp using (t, c, load_no)),
g as (select nt.t, nt.c, nt.load_no, nt.m, p.x from nt join (select distinct t, c, x from s where x is not null) p using (t, c) where nt.m > 0),
k as (select t, c, load_no, x, count(*) as n from s where x is not null group by all),
f as (select g.t, g.c, g.load_no, g.m, g.x, coalesce(sum(k.n) over (partition by g.t, g.c, g.load_no order by g.x), 0) / g.m as f from g left join k using (t, c, load_no, x)),
d as (select a.t, a.c, a.load_no, b.load_no as other, max(abs(a.f - b.f)) as d, max(b.m) as bm from f a join f b on a.t = b.t and a.c = b.c and a.x = b.x and a.load_no <> b.load_no group by all),
ks as (select t, c, load_no, median(d) as ks, median(sqrt(1.0 / bm)) as noise from d group by all),
j as (select nt.*, ks, noise, count(*) over w as loads, count(nullif(m, 0)) over w as having_m, median(null_share) over w as m1, median(unreadable) over w as m2, median(odd) over w as m3, median(negative) over w as m4, median(zero) over w as m5, median(top) over w as m6 from nt left join ks using (t, c, load_no) window w as (partition by t, c))
select t as table_name, c as column_name, load_no from j where loads >= 3 and (abs(null_share - m1) > 0.06 + 6 * sqrt(m1 * (1 - m1) / rows) or abs(unreadable - m2) > 0.06 + 6 * sqrt(m2 * (1 - m2) / greatest(1, filled)) or abs(odd - m3) > 0.06 + 6 * sqrt(m3 * (1 - m3) / greatest(1, filled)) or abs(negative - m4) > 0.06 + 6 * sqrt(m4 * (1 - m4) / greatest(1, filled)) or abs(zero - m5) > 0.06 + 6 * sqrt(m5 * (1 - m5) / greatest(1, filled)) or abs(top - m6) > 0.06 + 6 * sqrt(m6 * (1 - m6) / greatest(1, filled)) or coalesce(ks > 0.06 + 1.7 * sqrt(noise * noise + 1.0 / nullif(m, 0)), false) or (m = 0 and having_m > 0))"""
