"""Problem 2: deliveries whose schemas drift from file to file.

Every file's schema is read from its records in parallel (names, JSON kinds,
how often), files are compared with the file before them, and the differences
are logged in order.  Fields that go and fields that come in the same file are
held against each other by content: the shares of value features (numeric
places, words, ends, shapes, lengths) that two names have in common, in the
feed and in all feeds of the system.  Two names that ever stand in one file are
different fields.  Mutual best pairs above a threshold are renames.

The renames lead every name back to the feed's first name for the field; the
kinds of a field over all files are folded through a lattice (boolean and
number below string, single-valued objects by their value, lists by their
members) to one type that holds every value, and every record is cast to it:
"500 g" stays a text, and so does the field it stands in.

Defined results: payloads that are null or no JSON object have no fields (their
records stay in the table, with nulls); a field whose values in a file are all
null has no kind there and is not retyped; of kinds that tie, the first in
alphabetical order counts; a file sent twice is one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.session import cut, table

#: Least content similarity of a rename.
THRESHOLD = 0.5
KEY = ["feed_id", "file_no"]


def _merged(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the files: merged, not broadcast, as the planner knows a written table by its packed size only, a small part of what it takes in the driver's memory."""
    return df.hint("merge")


def fields(records: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """One row per record and top-level field: the kept columns, name, kind (null for JSON null), leaf (text of the value inside)."""
    keep = keep or [*KEY]
    parsed = records.select(*keep, F.from_json(payload, "map<string,variant>").alias("m"))
    rows = parsed.select(*keep, F.explode("m").alias("name", "v"))
    of = F.schema_of_variant("v")
    kind = F.when(F.col("v").isNull() | F.is_variant_null("v"), None).when(of.startswith("OBJECT"), "object").when(of.startswith("ARRAY"), "array").when(of == "STRING", "string").when(of == "BOOLEAN", "boolean").when(of != "VOID", "number")
    text = F.try_variant_get("v", "$", "string")
    inside = F.map_values(F.from_json(F.to_json("v"), "map<string,string>"))
    leaf = F.when(kind == "object", F.when(F.exists(inside, lambda x: x.isNotNull()), F.array_join(inside, ","))).when(kind == "array", F.regexp_replace(F.to_json("v"), r'[\[\]"]', "")).otherwise(text)
    return rows.select(*keep, "name", kind.alias("kind"), leaf.alias("leaf"))



#: What a feature of full weight counts; features that are parts of one text share their weight.
WHOLE = 1 << 20


def features(leaf: Column) -> Column:
    """What a value shows of its field, as array of (feature, w): the place of a number and whether it has decimals, or words, ends, shape and length of a text.

    All of a text counts, however long: its words in pieces of six signs weigh
    three features together (less if there are fewer pieces), the pieces of its
    shape two.
    """

    def weigh(names: Column, w: Column) -> Column:
        return F.transform(names, lambda f: F.struct(f.alias("feature"), w.cast("long").alias("w")))

    def shared(mark: str, pieces: Column, w: Column) -> Column:
        return F.when(F.size(pieces) > 0, weigh(F.transform(pieces, lambda x: F.concat(F.lit(mark), x)), F.greatest(F.lit(1), F.floor(w * WHOLE / F.greatest(F.size(pieces), F.lit(1)))))).otherwise(none)

    none = F.array().cast("array<struct<feature:string,w:bigint>>")
    one = lambda f, w=WHOLE: weigh(F.array(f), F.lit(w))
    place = lambda v: F.round(F.log10(v + 0.05) * 2).cast("string")

    def shown(low: Column, amount: Column) -> Column:
        number = F.concat(one(F.concat(F.lit("d:"), amount.contains(".").cast("string"))), one(F.concat(F.lit("b:"), place(amount.try_cast("double"))), 2 * WHOLE))
        words = F.regexp_extract_all(low, F.lit(r"[\p{L}0-9]{1,6}"), F.lit(0))
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[0-9]+", "9"), r"\p{L}+", "a"), r"(a )+a", "a a")
        ends = F.concat(one(F.concat(F.lit("p:"), F.substring(low, 1, 2)), WHOLE // 2), one(F.concat(F.lit("e:"), F.substring(low, -2, 2)), WHOLE // 2))
        text = F.concat(shared("w:", words, F.least(F.lit(3), F.size(words))), shared("s:", F.regexp_extract_all(shape, F.lit(r"(?s).{1,16}"), F.lit(0)), F.lit(2)), ends, one(F.concat(F.lit("l:"), F.round(F.log2(F.length(low) + 1)).cast("string"))))
        # The number inside a code has its place too, so that a code and its bare number have something in common; so have the wordings of truth values.
        inner = F.regexp_extract(low, r"([0-9]+)[^0-9.]*$", 1)
        code = F.when((inner != "") & ~amount.contains("."), one(F.concat(F.lit("i:"), place(inner.try_cast("double"))))).otherwise(none)
        truth = F.when(low.isin("true", "yes", "1"), one(F.lit("t:1"), 3 * WHOLE)).when(low.isin("false", "no", "0"), one(F.lit("t:0"), 3 * WHOLE)).otherwise(none)
        return F.concat(F.when(amount != "", number).when(F.size(truth) > 0, none).otherwise(text), code, truth)

    low = F.lower(leaf)
    amount = F.regexp_extract(low, r"^[$]?([0-9]+(?:[.][0-9]+)?)(?: ?[a-z]{1,3})?$", 1)
    # Read once, looked at often.
    return F.get(F.transform(F.array(F.struct(low.alias("low"), amount.alias("amount"))), lambda x: shown(x["low"], x["amount"])), F.lit(0))


def schemas(rows: DataFrame) -> DataFrame:
    """feed_id, file_no, name, kind (of most non-null values, or null), bearers (records with the name)."""
    counts = rows.groupBy(*KEY, "name", "kind").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("n", F.translate("kind", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))))
    return counts.groupBy(*KEY, "name").agg(best.alias("kind"), F.sum("n").alias("bearers"))


def steps(files: DataFrame) -> DataFrame:
    """feed_id, file_no, prev (the next lower file_no of the feed)."""
    f = files.select(*KEY).distinct()
    return f.withColumn("prev", F.lag("file_no").over(W.partitionBy("feed_id").orderBy("file_no"))).where("prev is not null")


def _shares(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, name, feature, share of the name's features."""
    n = rows.groupBy(*by, "name", "feature").agg(F.sum("n").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by, "name"))).drop("n")


def _common(pairs: DataFrame, shares: DataFrame, by: list[str], out: str) -> DataFrame:
    a = shares.withColumnsRenamed({"name": "old_name", "share": "sa"})
    b = shares.withColumnsRenamed({"name": "new_name", "share": "sb"})
    p = pairs.select(*by, "old_name", "new_name").distinct()
    got = p.join(_merged(a), [*by, "old_name"]).join(_merged(b), [*by, "new_name", "feature"]).groupBy(*by, "old_name", "new_name").agg(F.sum(F.least("sa", "sb")).alias(out))
    return got


def changes(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The ordered log: feed_id, file_no, change_kind, old_name, new_name, old_kind, new_kind, similarity (of renames)."""
    records = records.where("feed_id is not null and file_no is not null")
    rows = fields(records, keep=[*KEY, "system_name"])
    seen = schemas(rows)
    step = steps(records)
    # Whether (nearly) every record of the file bears the name.
    full = (F.col("bearers") >= 0.97 * F.col("records")).cast("int").alias("full")
    seen = cut(seen.join(_merged(records.groupBy(*KEY).agg(F.count(F.lit(1)).alias("records"))), KEY).select(*KEY, "name", "kind", "bearers", full))
    cur = step.join(_merged(seen), KEY)
    old = step.join(_merged(seen.withColumnRenamed("file_no", "prev")), ["feed_id", "prev"])
    both = cur.select(*KEY, "name", F.col("kind").alias("new_kind"), F.col("full").alias("new_full")).join(old.select(*KEY, "name", F.col("kind").alias("old_kind"), F.col("full").alias("old_full"), F.lit(True).alias("was")), [*KEY, "name"], "full")
    both = cut(both.join(_merged(cur.select(*KEY, "name", F.lit(True).alias("now"))), [*KEY, "name"], "left"))
    come = both.where("was is null").select(*KEY, F.col("name").alias("new_name"), "new_kind", "new_full")
    gone = both.where("now is null").select(*KEY, F.col("name").alias("old_name"), "old_kind", "old_full")
    system = records.groupBy("feed_id").agg(F.min("system_name").alias("system_name"))
    pairs = gone.join(_merged(come), KEY).join(_merged(system), "feed_id")
    # Names that stand in one file anywhere in the system are different fields.
    named = seen.join(_merged(system), "feed_id").select("system_name", *KEY, "name")
    kinds = pairs.select("system_name", "old_name", "new_name").distinct()
    together = kinds.join(_merged(named.withColumnRenamed("name", "old_name")), ["system_name", "old_name"]).join(_merged(named.withColumnRenamed("name", "new_name")), ["system_name", *KEY, "new_name"], "left_semi").select("system_name", "old_name", "new_name").distinct()
    pairs = cut(pairs.join(together, ["system_name", "old_name", "new_name"], "left_anti"))
    # Features only of names that take part in a pair.
    wanted = pairs.select("system_name", F.explode(F.array("old_name", "new_name")).alias("name")).distinct()
    values = rows.where("leaf is not null").join(wanted, ["system_name", "name"], "left_semi").select("system_name", "feed_id", "name", F.explode(features(F.col("leaf"))).alias("x"))
    values = cut(values.groupBy("system_name", "feed_id", "name", F.col("x.feature").alias("feature")).agg(F.sum("x.w").alias("n")))
    here = _common(pairs, _shares(values, ["feed_id"]), ["feed_id"], "here")
    everywhere = _common(pairs, _shares(values, ["system_name"]), ["system_name"], "everywhere")
    letters = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, r"([a-z])([A-Z])", "$1_$2")), r"[^a-z0-9]+"), lambda w: w != ""))
    name = F.size(F.array_intersect(letters("old_name"), letters("new_name"))) / F.size(F.array_union(letters("old_name"), letters("new_name")))
    scored = pairs.join(_merged(here), ["feed_id", "old_name", "new_name"], "left").join(everywhere, ["system_name", "old_name", "new_name"], "left")
    scored = scored.withColumn("similarity", F.greatest(F.coalesce("here", F.lit(0.0)), F.coalesce("everywhere", F.lit(0.0))) * 0.75 + 0.15 * name + F.when(F.col("old_full") == F.col("new_full"), F.when(F.col("old_full") == 1, 0.25).otherwise(0.1)).otherwise(0.0)).where(F.col("similarity") >= threshold)
    rank = lambda c: F.row_number().over(W.partitionBy(*KEY, c).orderBy(F.desc("similarity"), "old_name", "new_name"))
    renamed = cut(scored.withColumn("ra", rank("old_name")).withColumn("rb", rank("new_name")).where("ra = 1 and rb = 1"))
    none = F.lit(None).cast("double").alias("similarity")
    blank = F.lit("")
    log = renamed.select(*KEY, F.lit("renamed").alias("change_kind"), "old_name", "new_name", "old_kind", "new_kind", F.round("similarity", 4).alias("similarity"))
    log = log.unionByName(renamed.where("old_kind <> new_kind").select(*KEY, F.lit("retyped").alias("change_kind"), "old_name", "new_name", "old_kind", "new_kind", none))
    log = log.unionByName(both.where("was and now and old_kind <> new_kind").select(*KEY, F.lit("retyped").alias("change_kind"), F.col("name").alias("old_name"), F.col("name").alias("new_name"), "old_kind", "new_kind", none))
    log = log.unionByName(come.join(_merged(renamed.select(*KEY, "new_name")), [*KEY, "new_name"], "left_anti").select(*KEY, F.lit("added").alias("change_kind"), blank.alias("old_name"), "new_name", F.lit(None).cast("string").alias("old_kind"), "new_kind", none))
    return log.unionByName(gone.join(_merged(renamed.select(*KEY, "old_name")), [*KEY, "old_name"], "left_anti").select(*KEY, F.lit("removed").alias("change_kind"), "old_name", blank.alias("new_name"), "old_kind", F.lit(None).cast("string").alias("new_kind"), none))


def roots(log: DataFrame, seen: DataFrame, rounds: int = 1000) -> DataFrame:
    """feed_id, file_no, name, field: the first name in the feed of the field that bears the name in the file.

    A chain of renames is followed back one step a round, for all feeds at
    once; rounds guards against a log that leads in a circle: a call that reaches it fails.
    """
    back = cut(log.where("change_kind = 'renamed'").select("feed_id", F.col("new_name").alias("field"), F.col("file_no").alias("at"), "old_name"))
    at = cut(seen.select(*KEY, "name", F.col("name").alias("field"), F.col("file_no").alias("upto")))
    for _ in range(rounds):
        last = at.join(_merged(back), ["feed_id", "field"]).where("at <= upto").groupBy(*KEY, "name").agg(F.max_by(F.struct("old_name", "at"), "at").alias("b"))
        if last.isEmpty():
            return at.select(*KEY, "name", "field")
        at = cut(at.join(_merged(last), [*KEY, "name"], "left").select(*KEY, "name", F.coalesce("b.old_name", "field").alias("field"), F.coalesce(F.col("b.at") - 1, F.when(F.col("b").isNull(), F.lit(-1))).alias("upto")))
    raise RuntimeError(f"more than {rounds} renames of one field")


#: A number as JSON writes it, or an amount in dollars: a text of this form says no more than the number.
NUMERAL = r"^[$]?-?(?:0|[1-9][0-9]{0,14})(?:[.][0-9]{1,9})?$"
TRUTHS = {"true": True, "false": False}


def lattice(rows: DataFrame) -> DataFrame:
    """field, type: the kinds of all values of a field (rows: field, kind, leaf) folded to the least type that holds every one.

    boolean and double lie below string, next to each other: truth values are
    boolean, numbers (and texts that are one, digit for digit) double, all else
    string, and so is a field of both.  No value is lost in the cast.
    """
    value = F.when((F.col("kind") == "boolean") | F.col("leaf").isin(*TRUTHS), 1).when((F.col("kind") == "number") | F.col("leaf").rlike(NUMERAL), 2).otherwise(4)
    n = rows.where("kind is not null and leaf is not null").groupBy("field").agg(F.bit_or(value).alias("k"))
    return n.select("field", F.when(F.col("k") == 1, "boolean").when(F.col("k") == 2, "double").otherwise("string").alias("type"))


def unified(records: DataFrame, log: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """All records as one table: record_no, feed_id, file_no and a column for each field, cast to its folded type.

    The number of columns is that of the fields' first names; more than most
    are refused, as no table could hold them.
    """
    log = cut(log if log is not None else changes(records))
    flat = fields(records, keep=["record_no", *KEY])
    named = roots(log, schemas(flat))
    flat = cut(flat.join(_merged(named), [*KEY, "name"]).select("record_no", "field", "kind", "leaf"))
    types = {r["field"]: r["type"] for r in lattice(flat).orderBy("field").limit(most + 1).collect()}
    if len(types) > most:
        raise ValueError(f"more than {most} fields")
    number = F.regexp_replace("leaf", "^[$]", "").try_cast("double")
    truth = F.when(F.col("leaf") == "true", True).when(F.col("leaf") == "false", False)
    cast = {"double": number, "boolean": truth, "string": F.col("leaf")}
    wide = flat.groupBy("record_no").agg(*[F.max(F.when(F.col("field") == f, cast[t])).alias(f) for f, t in types.items()]) if types else flat.select("record_no").distinct()
    return records.select("record_no", *KEY).join(_merged(wide), "record_no", "left")


def p2_found(spark, folder):
    return changes(table(spark, folder, "feed_records")).select(*KEY, "change_kind", "old_name", "new_name")


def p2_changes(spark, folder):
    return changes(table(spark, folder, "feed_records"))


def p2_table(spark, folder):
    return unified(table(spark, folder, "feed_records"))
