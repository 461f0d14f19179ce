"""Queries of the problems tagged llm, and their SQL where SQL can say it."""

from __future__ import annotations

from weft.llm.canonical import p5_found, p5_values
from weft.llm.encoding import p8_ids
from weft.llm.linkage import p3_found, p3_links
from weft.llm.mixing import p9_mix, p9_shares
from weft.llm.reading import p10_found, p10_levels
from weft.llm.same_product import p1_found, p1_groups, p1_stages
from weft.llm.survivors import p7_found, p7_golden

QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p1_stages, p3_found, p3_links, p5_found, p5_values, p7_found, p7_golden, p8_ids, p9_mix, p9_shares, p10_found, p10_levels)}

SQL: dict[str, str] = {}

SQL["p7_found"] = """with n as (select count(list_price) as n, quantile_disc(inventory_count, 0.9) filter (inventory_count >= 0 and inventory_count not in (-1, 99999, 999999, 9999999)) as q from deduplicated_output where cluster_id is not null),
std as (select unnest([0.0, 0.01, 9999.99, 99999.99, 999999.99, 99999.0, 999999.0])::double as v union select list_price from deduplicated_output, n where cluster_id is not null and list_price is not null group by list_price, n.n having count(*) >= greatest(6, 0.004 * n.n)),
ev as (select cluster_id, coalesce(lower(product_category), '') as category, floor(log10(abs(list_price)) / 0.1)::bigint as bin from deduplicated_output where cluster_id is not null and list_price <> 0 and list_price <> -1 and abs(list_price) not in (select v from std)),
cat as (select category, bin, count(*) as n from ev group by 1, 2),
run as (select category, bin, sum(n) over (partition by category order by bin) as run, sum(n) over (partition by category) as total from cat),
cen as (select category, min(bin) as centre from run where run * 2 >= total group by 1),
mine as (select e.cluster_id, e.bin, count(*) as n, max(category) as category from ev e group by 1, 2),
m as (select cluster_id, bin, n, centre, sum(n) over (partition by cluster_id order by bin range between 3 preceding and 3 following) as near from mine left join cen using (category)),
p as (select *, case when abs(bin - centre) * 0.1 > 1.0 then 0.25 * near else near end as score, abs(bin - coalesce(centre, bin)) as off from m),
best as (select cluster_id, bin from (select cluster_id, bin, off, row_number() over (partition by cluster_id order by score desc, off, n desc, bin) as k from p) where k = 1 and off * 0.1 <= 1.5),
usual as (select m.cluster_id, sum((m.bin + 0.5) * m.n) / sum(m.n) * 0.1 as usual from m join best b on m.cluster_id = b.cluster_id and abs(m.bin - b.bin) <= 3 group by 1),
several as (select cluster_id from deduplicated_output where cluster_id is not null group by 1 having count(*) >= 2),
r as (select d.*, coalesce(list_price > 0 and list_price not in (select v from std) and abs(case when list_price > 0 then log10(list_price) end - usual) <= log10(5.0), false) as okp, coalesce(inventory_count >= 0 and inventory_count not in (99999, 999999, 9999999) and inventory_count <= sqrt(10) * greatest(1, coalesce(q, 1)), false) as okc from deduplicated_output d join several using (cluster_id) left join usual using (cluster_id), n),
f as (select cluster_id, 'list_price' as field_name, row_id, updated_at, source_records from r where okp union all select cluster_id, 'inventory_count', row_id, updated_at, source_records from r where okc),
k as (select *, row_number() over (partition by cluster_id, field_name order by updated_at desc nulls last, coalesce(source_records, 0) desc, row_id) as k from f)
select cluster_id, field_name, row_id from k where k = 1"""
