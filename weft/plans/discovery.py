"""Queries of domain discovery and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.metrics import threshold
from weft.operators import domains as D
from weft.operators import graph as G
from weft.operators import profiling as P
from weft.plans.query import query
from weft.session import cut, table

# Columns of text in several tables: (dataset, column), in the order of their ids.
COLUMNS = [("cluster_2_unified", ["product_category", "brand"]), ("customer", ["c_mktsegment"]), ("deduplicated_output", ["brand", "product_category"]), ("modern_products", ["category", "brand"]), ("nation", ["n_name"]), ("part", ["p_brand", "p_type"]), ("region", ["r_name"]), ("third_system_products", ["category_name", "brand_name"])]

WS = r"[ \t\n\r\f\v]+"


def _cells() -> str:
    out, k = [], 0
    for t, cs in COLUMNS:
        for c in cs:
            out.append(f"select {k} as column_id, trim(regexp_replace(upper({c}::varchar), '{WS}', ' ', 'g')) as term from {t}")
            k += 1
    return " union all ".join(out)


TERMS = f"terms as (select column_id, term, count(*) as n from ({_cells()}) where term <> '' group by 1, 2)"
INDEX = f"{TERMS}, idx as (select term, row_number() over (order by encode(term)) - 1 as term_id, list({{'column_id': column_id, 'n': n}} order by column_id) as columns, list(column_id order by column_id) as key from terms group by term)"
EQS = f"{INDEX}, heads as (select key, min(term_id) as eq, count(*) as n_terms from idx group by key), sums as (select key, c.column_id as column_id, sum(c.n)::bigint as n from (select key, unnest(columns) as c from idx) group by 1, 2), cls as (select eq, column_id, n, n_terms, len(key) as k from heads join sums using (key))"


def terms(spark, d):
    out = None
    for t, c in COLUMNS:
        x = P.cells(table(spark, d, t), t, c)
        out = x if out is None else out.unionByName(x)
    return D.column_terms(out)


def classes(spark, d):
    return D.equivalence_classes(cut(D.term_index(cut(terms(spark, d)))))


@query(f"with {TERMS} select column_id::integer as column_id, term, n from terms")
def column_terms(spark, d):
    return terms(spark, d)


@query(f"""with {TERMS} select column_id::integer as column_id, round(avg((not regexp_matches(term, '^[-+]?[0-9]+$') and not regexp_matches(term, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'))::int), 6) as share from terms group by 1 having share > 0.5""")
def text_columns(spark, d):
    return D.text_columns(terms(spark, d))


@query(f"""with {TERMS} select column_id::integer as column_id, round(avg((length(term) <= 12)::int), 6) as share from terms group by 1 having avg((length(term) <= 12)::int) >= 0.25""")
def short_columns(spark, d):
    return D.short_columns(terms(spark, d), 12, "GEQ0.25")


@query(f"with {INDEX} select term_id, term, len(columns)::integer as n_columns, list_sum(list_transform(columns, lambda c: c.n))::bigint as n from idx")
def term_index(spark, d):
    i = D.term_index(terms(spark, d))
    return i.select("term_id", "term", F.size("columns").alias("n_columns"), F.aggregate("columns", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n"))


@query(f"with {EQS} select eq, column_id::integer as column_id, n, n_terms from cls")
def equivalence_classes(spark, d):
    c, _ = classes(spark, d)
    return c.select("eq", F.explode("columns").alias("c"), "n_terms").select("eq", "c.column_id", "c.n", "n_terms")


@query(f"with {EQS} select h.eq, i.term_id from heads h join idx i using (key)")
def class_members(spark, d):
    return classes(spark, d)[1]


@query(f"with {EQS} select a.column_id::integer as a, b.column_id::integer as b, count(*) as shared from cls a join cls b on a.eq = b.eq and a.column_id < b.column_id group by 1, 2")
def column_overlap(spark, d):
    c = classes(spark, d)[0].select("eq", F.explode("columns").alias("c")).select("eq", F.col("c.column_id").alias("k"))
    return c.selectExpr("eq", "k a").join(c.selectExpr("eq", "k b"), "eq").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


O = f"{EQS}, o as (select a.eq as a, b.eq as b, a.k as ka, b.k as kb, count(*) as o from cls a join cls b on a.column_id = b.column_id and a.eq <> b.eq group by 1, 2, 3, 4)"


@query(f"with {O} select a, b, round(o::double / (ka + kb - o), 6) as sim from o")
def eq_ji(spark, d):
    return D.similarities(classes(spark, d)[0], "JI").select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"with {O} select a, b, round(case when ka + kb - o = o then 1.0 else ln(o + 1) / ln(ka + kb - o + 1) end, 6) as sim from o")
def eq_logji(spark, d):
    return D.similarities(classes(spark, d)[0], "LOGJI").select("a", "b", F.round("sim", 6).alias("sim"))


W_ = f"{EQS}, m as (select column_id, max(n) as most from cls group by 1), w as (select eq, column_id, n, (0.5 + 0.5 * n / most) * ln((select count(distinct column_id) from cls)::double / k) as w from cls join m using (column_id))"


@query(f"with {W_} select eq, column_id::integer as column_id, round(w, 6) as w from w")
def eq_tficf_weights(spark, d):
    return D.weights(classes(spark, d)[0]).select("eq", "column_id", F.round("w", 6).alias("w"))


S_ = f"{W_}, t as (select eq, sum(w) as t from w group by 1), p as (select x.eq as a, y.eq as b, sum(least(x.w, y.w)) as m from w x join w y on x.column_id = y.column_id and x.eq <> y.eq group by 1, 2), sims as (select a, b, coalesce(m / nullif(ta.t + tb.t - m, 0), 0) as sim from p join t ta on ta.eq = a join t tb on tb.eq = b where m > 0)"


@query(f"with {S_} select a, b, round(sim, 6) as sim from sims where sim > 0")
def eq_weighted_ji(spark, d):
    return D.similarities(classes(spark, d)[0], "TF-ICF").select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"with {O}, s as (select a as eq, b as other, round(o::double / (ka + kb - o), 12) as sim from o) select eq, other, round(sim, 6) as sim, row_number() over (partition by eq order by sim desc, other)::integer as rank from s")
def context_signature_ranked(spark, d):
    s = D.similarities(classes(spark, d)[0], "JI").withColumn("sim", F.round("sim", 12))
    return D.ranked(s).withColumn("sim", F.round("sim", 6))


def _signature(spark, d, how="LIBERAL"):
    c, m = classes(spark, d)
    c = cut(c)
    b = cut(D.blocks(D.similarities(c, "JI")))
    return c, m, cut(D.robust(b, c, how))


@query()
def signature_blocks(spark, d):
    """Blocks of every class's context signature (a state machine over one list)."""
    return D.blocks(D.similarities(classes(spark, d)[0], "JI"))


@query()
def robust_signatures_liberal(spark, d):
    return _signature(spark, d)[2]


@query()
def robust_signatures_ignore_last(spark, d):
    return _signature(spark, d, "IGNORE-LAST")[2]


@query()
def robust_signatures_common_column(spark, d):
    return _signature(spark, d, "COMMON-COLUMN")[2]


def _expanded(spark, d):
    c, m, s = _signature(spark, d)
    return c, m, s, D.expand(s, c)


@query()
def expanded_columns(spark, d):
    """Columns with the classes that their signatures support (iterative)."""
    return _expanded(spark, d)[3]


@query(f"with {EQS} select column_id::integer as column_id, eq from cls")
def unexpanded_columns(spark, d):
    """no-expand: the columns as they are."""
    return classes(spark, d)[0].select("eq", F.explode("columns").alias("c")).select("c.column_id", "eq")


@query(f"with {EQS}, s as (select column_id, list(eq order by eq) as l from cls group by 1), g as (select l, min(column_id) as domain_id from s group by l) select column_id::integer as column_id, domain_id::integer as domain_id from s join g using (l)")
def columns_as_domains(spark, d):
    """Every column is a domain; columns of equal content are one, told by an order-free hash."""
    c = classes(spark, d)[0].select("eq", F.explode("columns").alias("c")).select(F.col("c.column_id").alias("column_id"), "eq")
    h = c.groupBy("column_id").agg(F.sum(F.xxhash64("eq").cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("k"))
    return h.join(h.groupBy("h", "k").agg(F.min("column_id").alias("domain_id")), ["h", "k"]).select("column_id", "domain_id")


def _local(spark, d):
    c, m, s, e = _expanded(spark, d)
    return c, m, cut(D.local_domains(e, s, c))


@query()
def local_domains(spark, d):
    return _local(spark, d)[2]


@query()
def strong_domains(spark, d):
    c, _, l = _local(spark, d)
    return D.strong_domains(l, c)


@query()
def domain_export(spark, d):
    """Terms of the strong domains in weighted blocks."""
    i = cut(D.term_index(cut(terms(spark, d))))
    c, m = D.equivalence_classes(i)
    c, m = cut(c), cut(m)
    s = cut(D.robust(cut(D.blocks(D.similarities(c, "JI"))), c))
    l = cut(D.local_domains(D.expand(s, c), s, c))
    strong = cut(D.strong_domains(l, c))
    return D.exported(D.strong_weights(strong, l), m, i)


@query(f"""with {O}, s as (select least(floor(o::double / (ka + kb - o) * 100), 99)::integer as bin from o), h as (select bin, count(*) as n from s group by 1),
c as (select bin, sum(n) over w as lo, sum(n * bin) over w as lo_s, sum(n) over () as al, sum(n * bin) over () as al_s from h window w as (order by bin)),
v as (select bin, coalesce(lo * (al - lo) * pow(lo_s / lo - (al_s - lo_s) / nullif(al - lo, 0), 2), -1) as v from c)
select bin, round((bin + 1) / 100.0, 6)::double as threshold from v order by v desc, bin limit 1""")
def otsu_threshold(spark, d):
    return D.otsu(D.similarities(classes(spark, d)[0], "JI"))


@query(f"with {O} select floor(o::double / (ka + kb - o) * 10)::bigint as bin, count(*) as n from o group by 1")
def similarity_histogram(spark, d):
    return D.similarities(classes(spark, d)[0], "JI").groupBy(F.floor(F.col("sim") * 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {TERMS}, t as (select kind as truth_id, upper(canonical_name) as term from canonical_values), dn as (select column_id, count(*) as dn from terms group by 1), tn as (select truth_id, count(*) as tn from t group by 1),
o as (select column_id, truth_id, count(*) as o from terms join t using (term) group by 1, 2), s as (select truth_id, column_id, o::double / dn as p, o::double / tn as r from o join dn using (column_id) join tn using (truth_id)),
k as (select *, 2 * p * r / (p + r) as f, row_number() over (partition by truth_id order by 2 * p * r / (p + r) desc, column_id) as k from s)
select truth_id, column_id::integer as domain_id, round(p, 6) as "precision", round(r, 6) as recall, round(f, 6) as f1 from k where k = 1""")
def precision_recall_f1(spark, d):
    t = table(spark, d, "canonical_values").select(F.col("kind").alias("truth_id"), F.upper("canonical_name").alias("term"))
    return D.best_match(terms(spark, d).withColumnRenamed("column_id", "domain_id"), t)




def _links(spark, d):
    f = table(spark, d, "feed_records")
    return f.select(F.concat(F.lit("f"), "feed_id").alias("a"), F.concat(F.lit("s:"), "system_name", F.lit(":"), F.pmod(F.col("feed_id"), F.lit(3))).alias("b")).distinct()


LINKS = "e as (select distinct 'f' || feed_id as a, 's:' || system_name || ':' || (feed_id % 3) as b from feed_records)"


@query(f"""with recursive {LINKS}, u as (select a, b from e union select b, a from e), r as (select a as node, a as root from u union select u.b, r.root from r join u on r.node = u.a) select node, min(root) as component from r group by node""")
def connected_components(spark, d):
    return G.components(_links(spark, d))


@query("""with recursive e as (select distinct n_nationkey as a, (n_nationkey * 7 + n_regionkey) % 25 as b from nation), r as (select a as x, b as y from e union select r.x, e.b from r join e on r.y = e.a), n as (select a as node from e union select b from e),
m as (select p.x as node, p.y as other from r p join r q on p.x = q.y and p.y = q.x) select node::integer as node, least(node, coalesce((select min(other) from m where m.node = n.node), node))::integer as component from n""")
def strongly_connected_components(spark, d):
    n = table(spark, d, "nation")
    return G.strong_components(n.select(F.col("n_nationkey").alias("a"), F.pmod(F.col("n_nationkey") * 7 + F.col("n_regionkey"), F.lit(25)).alias("b")))


@query()
def maximal_cliques(spark, d):
    """Maximal cliques of the nations that share a region or a first letter."""
    n = table(spark, d, "nation").select("n_name", "n_regionkey", F.substring("n_name", 1, 1).alias("l"))
    a, b = n.selectExpr("n_name a", "n_regionkey ra", "l la"), n.selectExpr("n_name b", "n_regionkey rb", "l lb")
    e = a.join(b, F.col("ra") == F.col("rb")).select("a", "b").union(a.join(b, F.col("la") == F.col("lb")).select("a", "b")).where("a < b").distinct()
    return G.cliques(e)


@query("""with s as (select distinct o_custkey as id, o_orderpriority as x from orders union select distinct o_custkey, o_orderstatus from orders), k as (select id, list(x order by x) as l from s group by 1), g as (select array_to_string(l, '|') as set_id, l from k group by all)
select a.set_id as a, b.set_id as b, round(len(list_intersect(a.l, b.l))::double / len(list_distinct(a.l || b.l)), 6) as sim from g a join g b on a.set_id < b.set_id where round(len(list_intersect(a.l, b.l))::double / len(list_distinct(a.l || b.l)), 12) > 0.7""")
def overlap_graph(spark, d):
    o = table(spark, d, "orders")
    s = o.select("o_custkey", F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("x")).distinct().groupBy("o_custkey").agg(F.array_sort(F.collect_set("x")).alias("l"))
    sets = s.select("l").distinct().select(F.array_join("l", "|").alias("set_id"), F.explode("l").alias("element"))
    return G.overlap_graph(sets, threshold("GT0.7"))
