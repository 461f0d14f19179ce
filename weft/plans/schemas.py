"""Queries over schemas: tables and columns as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import metrics, text
from weft.operators import matching as M
from weft.operators import profiling as P
from weft.operators import unify as U
from weft.plans.query import query
from weft.session import cut, table

PRODUCTS = {"cluster_2_unified": "cluster_2_unified.csv", "deduplicated_output": "deduplicated_output.csv", "modern_products": "modern_products.csv", "third_system_products": "third_system_products.json"}
OTHERS = ("customer", "supplier", "nation", "region", "part")
# Inferred type of a stored type.
TYPE_OF = {"string": "string", "bigint": "integer", "int": "integer", "double": "float", "timestamp_ntz": "datetime", "timestamp": "datetime"}


def columns(spark, d, names):
    """dataset, column, ordinal, type from the tables' headers: no rows are read."""
    rows = [(n, c, i, TYPE_OF.get(t, "string")) for n in names for i, (c, t) in enumerate(table(spark, d, n).dtypes)]
    return spark.createDataFrame(rows, "dataset string, column string, ordinal int, type string")


def profiled(spark, d, names):
    p = P.column_profile(P.all_cells({n: table(spark, d, n) for n in names}))
    return columns(spark, d, names).join(p.select("dataset", "column", "alpha_ratio", "digit_ratio", "special_ratio", "space_ratio", "unique_ratio"), ["dataset", "column"])


@query("""with f(file) as (values ('cluster_2_unified.csv'), ('deduplicated_output.csv'), ('modern_products.csv'), ('third_system_products.json')), t as (select file, string_split_regex(regexp_replace(file, '\\.[^.]*$', ''), '[_\\-. ]+') as t from f)
select a.file as a, b.file as b, round(len(list_intersect(a.t, b.t))::double / len(list_distinct(a.t || b.t)), 6) as sim from t a join t b on a.file < b.file""")
def filename_jaccard(spark, d):
    f = spark.createDataFrame([(x,) for x in PRODUCTS.values()], "file string")
    p = f.selectExpr("file a", "1 o").join(f.selectExpr("file b", "1 o"), "o").where("a < b")
    return p.select("a", "b", F.round(M.file_name_similarity(F.col("a"), F.col("b")), 6).alias("sim"))


@query("""with t(t) as (values ('boolean'), ('integer'), ('float'), ('datetime'), ('string')) select a.t as a, b.t as b, case when a.t = b.t then 1.0 when a.t in ('integer', 'float') and b.t in ('integer', 'float') then 0.8 when a.t = 'string' or b.t = 'string' then 0.3 else 0.5 end::double as compatibility from t a, t b""")
def type_compat_matrix(spark, d):
    t = spark.createDataFrame([(x,) for x in ("boolean", "integer", "float", "datetime", "string")], "t string")
    p = t.selectExpr("t a", "1 o").join(t.selectExpr("t b", "1 o"), "o")
    return p.select("a", "b", metrics.type_compatibility(F.col("a"), F.col("b")).alias("compatibility"))


@query()
def table_similarities(spark, d):
    """The five criteria of table similarity for all pairs of tables."""
    return M.table_similarities(profiled(spark, d, [*PRODUCTS, *OTHERS]))


@query()
def best_column_match(spark, d):
    return M.best_matches(M.column_similarities(columns(spark, d, PRODUCTS)))


@query()
def mutual_best_match(spark, d):
    return M.mutual_matches(M.column_similarities(columns(spark, d, PRODUCTS)))


@query("""with v as (select 'modern' as s, 'category' as c, list(distinct category) as v from modern_products where category is not null union all select 'modern', 'brand', list(distinct brand) from modern_products where brand is not null),
w as (select 'category_name' as c, list(distinct category_name) as v from third_system_products where category_name is not null union all select 'brand_name', list(distinct brand_name) from third_system_products where brand_name is not null)
select v.c as column_a, w.c as column_b, round(len(list_intersect(v.v, w.v))::double / least(len(v.v), len(w.v)), 6) as overlap from v, w""")
def value_overlap(spark, d):
    """Common distinct values over the smaller set, by an equi-join on the values."""
    a = P.counted(P.cells(table(spark, d, "modern_products"), "a", ["category", "brand"])).where("value is not null").select(F.col("column").alias("column_a"), "value")
    b = P.counted(P.cells(table(spark, d, "third_system_products"), "b", ["category_name", "brand_name"])).where("value is not null").select(F.col("column").alias("column_b"), "value")
    na, nb = a.groupBy("column_a").agg(F.count(F.lit(1)).alias("na")), b.groupBy("column_b").agg(F.count(F.lit(1)).alias("nb"))
    o = a.join(b, "value").groupBy("column_a", "column_b").agg(F.count(F.lit(1)).alias("o"))
    every = na.withColumn("one", F.lit(1)).join(nb.withColumn("one", F.lit(1)), "one").drop("one")
    return every.join(o, ["column_a", "column_b"], "left").select("column_a", "column_b", F.round(F.coalesce("o", F.lit(0)) / F.least("na", "nb"), 6).alias("overlap"))


def _groups(spark, d, names):
    c = columns(spark, d, names)
    sims = {frozenset([(r["a"], r["column_a"]), (r["b"], r["column_b"])]): r["sim"] for r in M.column_similarities(c).where("sim >= 0.4").collect()}
    rows = [tuple(r) for r in c.orderBy("dataset", "ordinal").collect()]
    # The reference is the last table of the cluster.
    return rows, M.groups_from_reference(rows, sims, sorted(names)[-1])


@query()
def golden_schema(spark, d):
    """Golden columns of the product tables."""
    _, g = _groups(spark, d, PRODUCTS)
    return spark.createDataFrame(M.golden_schema(g), "ordinal int, golden_name string, type string, confidence double, sources array<string>")


@query()
def mapping_matrix(spark, d):
    """golden column x table: the source column, its type, and whether it is the reference's."""
    rows, g = _groups(spark, d, PRODUCTS)
    out = []
    for (i, name, *_), group in zip(M.golden_schema(g), g):
        have = {c[0]: c for _, c in group["members"]} | {group["reference"][0]: group["reference"]}
        out += [(name, t, have[t][1] if t in have else None, have[t][3] if t in have else None, t in have, t == group["reference"][0]) for t in sorted(PRODUCTS)]
    return spark.createDataFrame(out, "golden_column string, dataset string, source_column string, type string, mapped boolean, is_reference boolean")


@query()
def unmapped_columns(spark, d):
    rows, g = _groups(spark, d, PRODUCTS)
    got = {c[:2] for x in g for _, c in x["members"]} | {x["reference"][:2] for x in g}
    return spark.createDataFrame([(c[0], c[1]) for c in rows if c[:2] not in got], "dataset string, column string")


@query()
def mapping_quality(spark, d):
    """Mean, median, least and greatest similarity of the mapped columns, and coverage."""
    import statistics

    rows, g = _groups(spark, d, PRODUCTS)
    s = [x for y in g for x, _ in y["members"]]
    n = len({c[:2] for y in g for _, c in y["members"]} | {y["reference"][:2] for y in g})
    return spark.createDataFrame([(round(statistics.mean(s), 6), round(statistics.median(s), 6), round(min(s), 6), round(max(s), 6), sum(x >= 0.8 for x in s), sum(0.6 <= x < 0.8 for x in s), round(n / len(rows), 6))], "mean double, median double, least double, most double, high int, medium int, coverage double")


def _table_sims(spark, d):
    s = M.table_similarities(profiled(spark, d, [*PRODUCTS, *OTHERS])).collect()
    return sorted([*PRODUCTS, *OTHERS]), {(r["a"], r["b"]): r["similarity"] for r in s}


@query()
def table_clusters(spark, d):
    """Average-linkage clusters of tables at the best threshold of a sweep."""
    names, sims = _table_sims(spark, d)
    best = max(M.sweep(names, sims), key=lambda r: (r[5], -r[0]))
    return spark.createDataFrame([(n, i) for i, p in enumerate(M.upgma(names, sims, best[0])) for n in p], "dataset string, cluster_id int")


@query()
def threshold_sweep(spark, d):
    names, sims = _table_sims(spark, d)
    return spark.createDataFrame(M.sweep(names, sims), "threshold double, clusters int, quality double, silhouette double, balance double, score double")


@query()
def leader_clusters(spark, d):
    names, sims = _table_sims(spark, d)
    return spark.createDataFrame([(n, i) for i, p in enumerate(M.leader_clusters(names, sims, 0.5)) for n in p], "dataset string, cluster_id int")


@query()
def strategy_choice(spark, d):
    """How the product tables would be merged, from column overlap and candidate keys."""
    t = {n: table(spark, d, n) for n in PRODUCTS}
    o = P.column_overlap(t).agg(F.avg("jaccard")).first()[0]
    keys = [[r["column"] for r in P.candidate_keys(x).collect()] for x in t.values()]
    s = U.choose_strategy(2, o, keys)
    return spark.createDataFrame([(s.cluster, s.kind, s.key, round(o, 6))], "cluster int, strategy string, merge_key string, overlap double")


@query()
def tfidf_similarity(spark, d):
    return M.tfidf_columns(columns(spark, d, [*PRODUCTS, *OTHERS]))


@query()
def dataset_matrix(spark, d):
    return M.dataset_matrix(columns(spark, d, [*PRODUCTS, *OTHERS]))


@query()
def name_groups(spark, d):
    """Tables that share the first or last part of their name, in groups of two or more."""
    f = spark.createDataFrame([(x,) for x in PRODUCTS.values()], "file string")
    g = f.select("file", F.explode(F.array(F.struct(F.lit("prefix").alias("kind"), text.name_prefix(F.col("file")).alias("part")), F.struct(F.lit("suffix").alias("kind"), text.name_suffix(F.col("file")).alias("part")))).alias("x")).select("file", "x.*").where("part is not null")
    return g.groupBy("kind", "part").agg(F.array_sort(F.collect_list("file")).alias("files")).where(F.size("files") >= 2)


@query("""with c as (select table_name as dataset, column_name as "column", lower(column_name) as low from information_schema.columns where table_name in ('cluster_2_unified', 'deduplicated_output', 'modern_products', 'third_system_products', 'customer', 'supplier', 'nation', 'region', 'part')),
m(k, meaning, words) as (values (1, 'identifier', 'id|sku|asin|code|number'), (2, 'name', 'name|title'), (3, 'contact', 'email|phone|contact'), (4, 'address', 'address|city|state|zip|postal|country'), (5, 'date', 'date|time|created|signup|registration|timestamp'), (6, 'price', 'price|amount|cost|total|retail|current'), (7, 'quantity', 'quantity|qty|count|inventory|stock'), (8, 'status', 'status|active|premium|member|prime|loyalty|availability'), (9, 'measurement', 'weight|dimension|lbs|kg'), (10, 'category', 'category|type|subcategory'), (11, 'brand', 'brand|manufacturer|supplier|seller'))
select c.dataset, c."column", coalesce(string_agg(m.meaning, ', ' order by m.k), 'other') as meaning from c left join m on regexp_matches(c.low, m.words) group by 1, 2""")
def column_meanings(spark, d):
    c = columns(spark, d, [*PRODUCTS, *OTHERS])
    return spark.createDataFrame([(r["dataset"], r["column"], M.meaning(r["column"])) for r in c.collect()], "dataset string, column string, meaning string")


@query()
def token_frequencies(spark, d):
    """Words of column names, how often they occur, and whether a tenth of the columns end in them."""
    c = columns(spark, d, [*PRODUCTS, *OTHERS])
    n = c.count()
    t = c.select(text.name_tokens(F.col("column")).alias("t"))
    ends = t.groupBy(F.element_at("t", -1).alias("token")).agg(F.count(F.lit(1)).alias("ends"))
    return t.select(F.explode("t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(ends, "token", "left").select("token", "n", (F.coalesce("ends", F.lit(0)) >= 0.1 * n).alias("suffix"))


@query()
def kmeans_names(spark, d):
    """KMeans over hashed words of category spellings."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import HashingTF

    v = table(spark, d, "modern_products").select(F.lower("category").alias("v")).where("v is not null").distinct().select("v", F.filter(F.split("v", r"[^\p{L}]+"), lambda w: w != "").alias("t"))
    f = HashingTF(inputCol="t", outputCol="features", numFeatures=256).transform(v).orderBy("v")
    return KMeans(k=12, seed=5, maxIter=15).fit(f).transform(f).select("v", F.col("prediction").cast("int").alias("cluster"))


@query()
def dbscan_components(spark, d):
    """DBSCAN with two points to a core: components of spellings within 0.3 of a Levenshtein distance."""
    from weft.operators.graph import components
    from weft.operators.pairs import similar_strings

    v = table(spark, d, "modern_products").select(F.lower(F.trim("brand")).alias("v")).where("v <> ''").distinct()
    return components(cut(similar_strings(v, 0.7).select("a", "b")), v)
