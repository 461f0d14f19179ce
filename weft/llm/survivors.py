"""Problem 7: the surviving record of each group of duplicates.

Rows are unpivoted to (group, field, value).  For each field the rows whose
value is credible are compared by recency and trust: a row survives if no other
is at least as good in both and better in one (the skyline).  The survivors are
resolved by a lexicographic policy: latest, then most source records, then the
smallest row id.  Fields that the group's best record leaves empty are so filled
from the next layers that have them, field by field.

A group may hold any number of rows: they are first reduced to the best row of
each (group, field, trust), a sum that every task makes on its own rows, and
only those few are compared.

Credible values
  prices: above zero, no stand-in, and within FACTOR of the group's usual price.
      The usual price is the densest place of the group's logarithms, where a
      place more than a decade off the category's median counts a
      quarter; where places tie, the one nearest to that median decides.  A usual
      price more than one and a half decades off that median is none.
  counts: zero or more, no stand-in, and at most half an order of magnitude
      above the 90th percentile of the table.
  texts: not blank, and at least half as long as the group's longest.
Stand-ins are the listed values and any price that FREQUENT of all groups share.

Other columns than those named are left out.  Nulls: rows without group are left out; a null time is the earliest, null
source records count as 0.  A group without a credible value has none (null in
the record, no row in the choice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.session import cut, table

FACTOR = 5.0
FREQUENT = 0.004
# Stand-ins for a missing price and a missing count.
PRICE_STANDINS = [0.0, 0.01, 9999.99, 99999.99, 999999.99, 99999.0, 999999.0]
COUNT_STANDINS = [-1, 99999, 999999, 9999999]
TEXTS = ["product_name", "brand", "product_sku", "product_category", "manufacturer", "is_active", "dimensions", "source_file"]
NEEDED = ["cluster_id", "row_id", "source_records", "updated_at", "list_price", "inventory_count", "weight_lbs", *TEXTS]
#: Width of a price place, in decimal logarithms.
STEP = 0.1


def usual_prices(rows: DataFrame) -> DataFrame:
    """rows: cluster_id, category, v (price, or its amount if negative) -> cluster_id, usual (decimal logarithm)."""
    bins = rows.select("cluster_id", "category", F.floor(F.log10("v") / STEP).alias("bin"))
    cat = bins.groupBy("category", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("category")
    # The median place of each category.
    run = cat.withColumn("run", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    centre = run.where(F.col("run") * 2 >= F.col("all")).groupBy("category").agg(F.min("bin").alias("centre"))
    mine = bins.groupBy("cluster_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.max("category").alias("category")).join(centre, "category", "left")
    mine = mine.withColumn("category", F.max("category").over(W.partitionBy("cluster_id")))
    near = F.sum("n").over(W.partitionBy("cluster_id").orderBy("bin").rangeBetween(-3, 3))
    mine = mine.withColumn("near", near)
    # A place more than a decade from what the category costs counts a quarter.
    off = F.abs(F.col("bin") - F.coalesce("centre", F.col("bin")))
    mine = mine.withColumn("near", F.when(off * STEP > 1.0, 0.25 * F.col("near")).otherwise(F.col("near").cast("double")))
    best = mine.groupBy("cluster_id").agg(F.max_by("bin", F.struct("near", -F.abs(F.col("bin") - F.coalesce("centre", F.col("bin"))), "n", -F.col("bin"))).alias("bin"))
    # A single place that far from the category is no price either.
    best = best.join(mine.select("cluster_id", "bin", "centre"), ["cluster_id", "bin"]).where(F.abs(F.col("bin") - F.coalesce("centre", F.col("bin"))) * STEP <= 1.5).select("cluster_id", "bin")
    # The mean of the place and its neighbours, so that a price on a border is not off.
    mean = mine.select("cluster_id", F.col("bin").alias("b"), "n").join(best, "cluster_id").where(F.abs(F.col("b") - F.col("bin")) <= 3)
    return mean.groupBy("cluster_id").agg((F.sum((F.col("b") + 0.5) * F.col("n")) / F.sum("n") * STEP).alias("usual"))


def marked(rows: DataFrame) -> DataFrame:
    """Adds credible_price and credible_count to the rows of a deduplicated table."""
    rows = rows.where(F.col("cluster_id").isNotNull()).select(*[c for c in rows.columns if c in NEEDED])
    total = rows.agg(F.percentile_approx(F.when((F.col("inventory_count") >= 0) & ~F.col("inventory_count").isin(COUNT_STANDINS), F.col("inventory_count")), 0.9, 10000).alias("q")).first()
    # Every cluster counts once for a price, whatever the number of its rows.
    priced = cut(rows.where("list_price is not null").select("cluster_id", "list_price").distinct())
    clusters = priced.select("cluster_id").distinct().count()
    often = priced.groupBy("list_price").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(6, FREQUENT * clusters)).select(F.col("list_price").alias("__amount"), F.lit(True).alias("__often"))
    price = F.col("list_price")
    rows = rows.withColumn("__amount", F.abs(price)).join(often, "__amount", "left")
    standin = F.col("__amount").isin(PRICE_STANDINS) | F.coalesce("__often", F.lit(False))
    real = price.isNotNull() & (price != 0) & (price != -1) & ~standin
    evidence = rows.where(real).select("cluster_id", F.coalesce(F.lower("product_category"), F.lit("")).alias("category"), F.abs(price).alias("v"))
    out = rows.join(usual_prices(evidence), "cluster_id", "left")
    ok = (price > 0) & ~standin & (F.abs(F.log10(F.when(price > 0, price)) - F.col("usual")) <= F.log10(F.lit(FACTOR)))
    count = F.col("inventory_count")
    fine = (count >= 0) & ~count.isin(COUNT_STANDINS) & (count <= F.lit(10**0.5 * max(1, total["q"] or 1)))
    return out.withColumn("credible_price", F.coalesce(ok, F.lit(False))).withColumn("credible_count", F.coalesce(fine, F.lit(False))).drop("usual", "__amount", "__often")


def choices(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """cluster_id, field_name, row_id, value (as text), layer_size (rows of the skyline's cells).

    rows: cluster_id, row_id, source_records, updated_at and the fields; fields
    has, for each field, whether its value is credible.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value"), ok.alias("ok")) for f, ok in fields.items()]))
    flat = rows.select("cluster_id", "row_id", F.coalesce("source_records", F.lit(0)).alias("trust"), F.coalesce(F.col("updated_at").cast("timestamp_ltz").cast("double"), F.lit(-1e18)).alias("seen"), cells.alias("x")).where("x.ok")
    flat = flat.select("cluster_id", "x.field_name", "trust", "seen", "row_id", "x.value")
    best = flat.groupBy("cluster_id", "field_name", "trust").agg(F.max(F.struct("seen", (-F.col("row_id")).alias("low"), "value")).alias("b"))
    above = F.max("b.seen").over(W.partitionBy("cluster_id", "field_name").orderBy(F.desc("trust")).rowsBetween(W.unboundedPreceding, -1))
    skyline = best.withColumn("above", above).where(F.col("above").isNull() | (F.col("b.seen") > F.col("above")))
    out = skyline.groupBy("cluster_id", "field_name").agg(F.max(F.struct("b.seen", "trust", "b.low", "b.value")).alias("c"), F.count(F.lit(1)).alias("layer_size"))
    return out.select("cluster_id", "field_name", (-F.col("c.low")).alias("row_id"), F.col("c.value").alias("value"), "layer_size")


def of_several(rows: DataFrame) -> DataFrame:
    """Rows of groups of two or more rows."""
    return rows.join(rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2").select("cluster_id"), "cluster_id", "left_semi")


def golden(rows: DataFrame) -> DataFrame:
    """One record per group: cluster_id, source_rows, source_records, base_row_id and the best value of each field."""
    rows = marked(rows)
    longest = rows.groupBy("cluster_id").agg(*[F.max(F.length(F.trim(c))).alias(f"__{c}") for c in TEXTS])
    rows = rows.join(longest, "cluster_id")
    fields = {c: F.coalesce((F.trim(c) != "") & (2 * F.length(F.trim(c)) >= F.col(f"__{c}")), F.lit(False)) for c in TEXTS}
    fields |= {"list_price": F.col("credible_price"), "inventory_count": F.col("credible_count"), "weight_lbs": F.coalesce(F.col("weight_lbs") > 0, F.lit(False))}
    rows = cut(rows.select("cluster_id", "row_id", "source_records", "updated_at", *fields, *[ok.alias(f"ok_{c}") for c, ok in fields.items()]))
    chosen = choices(rows, {c: F.col(f"ok_{c}") for c in fields})
    wide = chosen.groupBy("cluster_id").agg(*[F.max(F.when(F.col("field_name") == c, F.col("value"))).alias(c) for c in fields])
    # The base record: of the records that none beats in completeness, recency and trust, the latest.
    full = sum((F.col(f"ok_{c}").cast("int") for c in fields), F.lit(0))
    cells = rows.select("cluster_id", full.alias("full"), F.coalesce("source_records", F.lit(0)).alias("trust"), F.coalesce(F.col("updated_at").cast("timestamp_ltz").cast("double"), F.lit(-1e18)).alias("seen"), "row_id")
    cells = cells.groupBy("cluster_id", "full", "trust").agg(F.max(F.struct("seen", (-F.col("row_id")).alias("low"))).alias("b"))
    by_full = W.partitionBy("cluster_id", "trust").orderBy(F.desc("full")).rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("above", F.max("b.seen").over(by_full)).where("above is null or b.seen > above")
    base = cells.groupBy("cluster_id").agg(F.max(F.struct("b.seen", "full", "trust", "b.low")).alias("c")).select("cluster_id", (-F.col("c.low")).alias("base_row_id"))
    sizes = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("source_rows"), F.sum("source_records").cast("long").alias("source_records"))
    out = sizes.join(base, "cluster_id").join(wide, "cluster_id", "left")
    return out.withColumn("list_price", F.col("list_price").cast("double")).withColumn("weight_lbs", F.col("weight_lbs").cast("double")).withColumn("inventory_count", F.col("inventory_count").cast("long"))


def p7_golden(spark, folder):
    return golden(table(spark, folder, "deduplicated_output"))


def p7_found(spark, folder):
    rows = marked(table(spark, folder, "deduplicated_output"))
    return choices(of_several(rows), {"list_price": F.col("credible_price"), "inventory_count": F.col("credible_count")}).select("cluster_id", "field_name", "row_id")
