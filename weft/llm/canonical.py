"""Problem 5: mapping freely typed entries to a reference list.

Entries are reduced to their distinct values before anything else.  A value is
normalised (entities, broken UTF-8, accents, case, spaced or reversed letters,
decorations such as shop suffixes and codes in brackets); its character
trigrams, word by word, are looked up in an inverted index of the reference
names, and candidates are scored by the cosine of trigrams weighted by inverse
document frequency.  A value is accepted for the best reference if the score
reaches a threshold and leads the next reference by a margin.

Other names of a reference (translations, synonyms) share few letters with it.
They come from a list of aliases, a parameter that is indexed together with the
names, and from the listings themselves: a value left open whose listings bear
one and the same reference in their other rows is taken for that reference.

Defined results: null entries and entries equal to a reference name are no
case; blank and meaningless entries get ref_id 0; of equal scores the margin
lets none through.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.session import cut, table

#: Least cosine, least lead over the next reference.
THRESHOLD, MARGIN = 0.62, 0.06
#: Companions: least number of listings that speak, least share of one reference.
SUPPORT, PURITY = 4, 0.8
#: Most rows of a reference list that is broadcast; longer ones are joined.
SMALL = 50_000

# Other names of categories.
ALIASES = {
    "Home & Kitchen": ["Household & Kitchen", "Kitchen & Home", "cook + home", "Haus und Küche", "Hm/Kitchn", "Kitchenware", "Housewares"],
    "Electronics": ["Consumer Electronics", "Elektronik", "Electronic goods", "Gadgets", "Elec."],
    "Clothing": ["Clothes", "Garments", "Apparel", "Kleidung", "wearing apparel", "Fashion"],
    "Sports & Outdoors": ["Outdoor sports", "Outdoor & Sport", "Sports equip.", "Sport und Freizeit", "Sporting goods"],
    "Beauty & Personal Care": ["Cosmetics", "Beauty/PC", "Schönheitspflege", "Personal care", "Toiletries"],
    "Books": ["Bücher", "Literature", "Reading matter"],
    "Toys & Games": ["Games and Toys", "kids toys", "Spielzeug", "Playthings"],
    "Luggage & Travel": ["Reisegepäck", "Travel bags", "Suitcases", "Travel goods"],
    "Health & Household": ["Gesundheit und Haushalt", "Health goods"],
    "Office Products": ["Office supplies", "Desk & office", "Bürobedarf", "OFC PROD", "Stationery"],
    "Pet Supplies": ["Pets", "Pet goods", "cat/dog supplies", "Tierbedarf", "pt supplies"],
    "Garden & Patio": ["lawn + garden", "Garten", "Gardening", "Outdoor living"],
    "Tools & Hardware": ["Hardware", "Hardware & Tools", "DIY tools", "Werkzeug"],
    "Automotive": ["Car parts", "Car accessories", "Autozubehör", "Vehicle accessories"],
    "Baby Products": ["Baby", "Baby goods", "Infant care", "Babybedarf", "Babyartikel"],
    "Grocery": ["Foodstuffs", "Food", "Groc.", "Lebensmittel", "Food & drink"],
    "Musical Instruments": ["Instruments", "Musikinstrumente", "Music gear"],
    "Lighting": ["Lights & Lamps", "Beleuchtung", "Lamps"],
    "Furniture": ["tables and chairs", "Möbel", "Furnishings"],
    "Footwear": ["Shoes", "foot wear", "Schuhe"],
    "Jewelry & Watches": ["Schmuck und Uhren", "Jewellery"],
    "Arts & Crafts": ["Kunst und Handwerk", "Craft supplies", "Bastelbedarf"],
    "Computers & Accessories": ["PC", "Computer peripherals", "comp. acc.", "PC & Zubehör", "Computerzubehör"],
    "TV & Audio": ["Sound and vision", "Hi-Fi", "Televisions, Speakers", "Fernseher und Audio"],
    "Cameras & Photo": ["Camera equipment", "Photo & Cameras", "Kameras", "Photography"],
    "Sports Nutrition": ["Protein & supplements", "Sporternährung", "Sportnahrung", "Supplements"],
    "Home Improvement": ["Heimwerken", "Renovation"],
    "Bedding & Bath": ["Bath towels & bedding", "Bettwäsche und Bad", "Linens"],
    "Storage & Organization": ["Storage boxes", "Aufbewahrung", "Organisers", "Storage & organisation"],
    "Cleaning Supplies": ["Putzmittel", "Cleaning products", "Household cleaners", "Reinigungsmittel"],
}
# Decorations around a name.
DECORATION = re.compile(r"^\s*all\s*>|^\s*by\s+|\((?:tm|r|[a-z]{2}-\d+)\)|[®™\"“”]|[\s_-]+(?:official|gmbh|inc|ltd|llc)\b\.?\s*$", re.I)
# Joining words.
JOINERS = {"and", "und", "et", "y"}


def forms(value: str | None) -> list[str]:
    """Normal forms of a value: usually one; two where its letters may stand in reverse."""
    s = html.unescape(value or "")
    for bad, good in (("Ã©", "é"), ("ã©", "é")):
        s = s.replace(bad, good)
    s = DECORATION.sub(" ", DECORATION.sub(" ", s))
    spaced = bool(re.fullmatch(r"\s*(?:\S\s+){3,}\S\s*", s))
    s = unicodedata.normalize("NFKD", s.casefold())
    s = "".join(ch for ch in s if not unicodedata.combining(ch))
    if spaced:
        # Single letters: words are parted by wider gaps or signs.
        s = re.sub(r"(?<=\w)\s(?=\w)", "", s)
    s = re.sub(r"(?<=[a-z])0|0(?=[a-z])", "o", s)
    words = [w for w in re.findall(r"[a-z0-9]+", s) if w not in JOINERS]
    out = [" ".join(words)]
    if spaced:
        out.append(" ".join(w[::-1] for w in reversed(words)))
    return [x for x in out if x]


def grams(text: str) -> list[str]:
    """Distinct trigrams of each word between blanks, and of the words run together (against lost blanks)."""
    out = set()
    for w in text.split():
        p = f" {w} "
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    joined = text.replace(" ", "")
    out.update(joined[i : i + 3] for i in range(len(joined) - 2))
    return sorted(out)


def _indexed(values: DataFrame, cols: list[str]) -> DataFrame:
    """Adds form and grams to the rows of distinct values (column value)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r, f, grams(f)) for r, v in zip(b[cols].itertuples(index=False, name=None), b["value"]) for f in forms(v)]
            yield pd.DataFrame(rows, columns=[*cols, "form", "grams"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values.select(cols).schema)
    return values.select(*dict.fromkeys([*cols, "value"])).mapInPandas(run, f"{schema}, form string, grams array<string>")


def match(values: DataFrame, reference: DataFrame, aliases: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """values: kind, value (distinct); reference: ref_id, kind, canonical_name -> kind, value, ref_id, score for the accepted ones."""
    spark = values.sparkSession
    known = reference.where("ref_id is not null and canonical_name is not null").select("ref_id", "kind", F.col("canonical_name").alias("value"))
    other = spark.createDataFrame([(c, a) for c, xs in (ALIASES if aliases is None else aliases).items() for a in xs] or [("", "")], "canonical string, value string")
    names = known.unionByName(other.join(known.select("ref_id", "kind", F.col("value").alias("canonical")), "canonical").select("ref_id", "kind", "value"))
    names = _indexed(names, ["ref_id", "kind"]).dropDuplicates(["ref_id", "kind", "form"]).withColumn("name", F.monotonically_increasing_id())
    names = cut(names)
    flat = names.select("name", "ref_id", "kind", F.explode("grams").alias("gram"))
    n = names.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    weight = flat.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("df")).join(n, "kind").select("kind", "gram", (F.log(F.col("n") / F.col("df")) + 0.3).alias("w"))
    norm = flat.join(weight, ["kind", "gram"]).groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    index = flat.join(weight, ["kind", "gram"]).join(norm, "name")
    small = names.count() <= SMALL
    hint = F.broadcast if small else (lambda d: d)
    rows = _indexed(values, ["kind", "value"]).select("kind", "value", "form", F.explode("grams").alias("gram"))
    # A trigram that no name has weighs as the rarest.
    lookup = rows.join(hint(weight), ["kind", "gram"], "left").join(hint(n), "kind").withColumn("q", F.coalesce("w", F.least(F.lit(5.0), F.log("n") + 0.3))).drop("n")
    own = lookup.groupBy("kind", "value", "form").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("own"))
    hits = lookup.where("w is not null").select("kind", "value", "form", "gram").join(hint(index), ["kind", "gram"])
    dot = hits.groupBy("kind", "value", "form", "ref_id", "name", "norm").agg(F.sum(F.col("w") * F.col("w")).alias("dot"))
    score = dot.join(own, ["kind", "value", "form"]).withColumn("cosine", F.col("dot") / (F.col("norm") * F.col("own")))
    # One swap of letters spoils four trigrams; of the candidates, those within two edits score by the letters that stay.
    # A cosine below a tenth neither is accepted nor comes near one that is; lengths over two apart are more than two edits.
    score = score.join(hint(names.select("name", F.col("form").alias("named"))), "name").where((F.col("cosine") >= 0.1) | (F.abs(F.length("form") - F.length("named")) <= 2))
    edits = F.levenshtein("form", "named")
    score = score.withColumn("score", F.when((edits <= 2) & (F.length("form") >= 6), F.greatest("cosine", 1 - edits / F.length("form"))).otherwise(F.col("cosine")))
    best = cut(score.groupBy("kind", "value", "ref_id").agg(F.max("score").alias("score")))
    first = best.groupBy("kind", "value").agg(F.max(F.struct("score", "ref_id")).alias("b"))
    second = best.join(first, ["kind", "value"]).where("ref_id <> b.ref_id").groupBy("kind", "value").agg(F.max("score").alias("next"))
    out = first.join(second, ["kind", "value"], "left").select("kind", "value", F.col("b.ref_id").alias("ref_id"), F.col("b.score").alias("score"), F.coalesce("next", F.lit(0.0)).alias("next"))
    return out.where((F.col("score") >= threshold) & (F.col("score") - F.col("next") >= margin))


def companions(entries: DataFrame, matched: DataFrame, support: int = SUPPORT, purity: float = PURITY) -> DataFrame:
    """kind, value, ref_id of open values whose listings bear one reference in their other rows.

    entries: kind, value, item (the listing), n (rows); matched: kind, value, ref_id.
    """
    marked = entries.where("item is not null").join(matched.select("kind", "value", "ref_id"), ["kind", "value"], "left")
    known = marked.where("ref_id is not null").groupBy("kind", "item").agg(F.max_by("ref_id", F.struct("n", "ref_id")).alias("ref"))
    votes = marked.where("ref_id is null").select("kind", "item", "value").join(known, ["kind", "item"]).groupBy("kind", "value", "ref").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy("kind", "value").agg(F.sum("n").alias("all"), F.max(F.struct("n", "ref")).alias("b"))
    return top.where((F.col("b.n") >= support) & (F.col("b.n") >= purity * F.col("all"))).select("kind", "value", F.col("b.ref").alias("ref_id"))


def canonical(entries: DataFrame, reference: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """entries: kind, value, item -> kind, value, ref_id for every distinct non-null value (0: unmatched)."""
    entries = cut(entries.where("value is not null").groupBy("kind", "item", "value").agg(F.count(F.lit(1)).alias("n")))
    values = cut(entries.select("kind", "value").distinct())
    exact = values.join(reference.select("kind", F.col("canonical_name").alias("value"), "ref_id"), ["kind", "value"])
    found = match(cut(values.join(exact.select("kind", "value"), ["kind", "value"], "left_anti")), reference, aliases).select("kind", "value", "ref_id")
    matched = cut(exact.select("kind", "value", "ref_id").unionByName(found))
    extra = companions(entries, matched)
    return values.join(matched.unionByName(extra), ["kind", "value"], "left").select("kind", "value", F.coalesce("ref_id", F.lit(0)).alias("ref_id"))


FIELDS = [("modern_products", "category", "category", "asin"), ("third_system_products", "category_name", "category", "item_code"), ("third_system_products", "brand_name", "brand", "item_code")]


def p5_values(spark, folder):
    """Every distinct entry with its reference."""
    parts = [table(spark, folder, t).select(F.lit(k).alias("kind"), F.col(c).alias("value"), F.col(i).alias("item")) for t, c, k, i in FIELDS]
    return canonical(parts[0].unionByName(parts[1]).unionByName(parts[2]), table(spark, folder, "canonical_values"))


def p5_found(spark, folder):
    mapped = cut(p5_values(spark, folder))
    ref = table(spark, folder, "canonical_values")
    out = None
    for t, c, k, _ in FIELDS:
        exact = ref.where(F.col("kind") == k).select(F.col("canonical_name").alias("value"))
        rows = table(spark, folder, t).where(F.col(c).isNotNull()).select("row_no", F.col(c).alias("value")).join(exact, "value", "left_anti")
        rows = rows.join(mapped.where(F.col("kind") == k).select("value", "ref_id"), "value").select(F.lit(f"{t}.{c}").alias("field_name"), "row_no", "ref_id")
        out = rows if out is None else out.unionByName(rows)
    return out
