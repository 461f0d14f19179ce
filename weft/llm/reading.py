"""Problem 10: reading level of documents.

Documents and their words form a bipartite graph.  Documents whose raters agree
are clamped to their level; a word's difficulty is the weighted mean of its
documents, a document's the weighted mean of its words, and the two are
computed in turn until the documents hardly change (harmonic propagation).  The
weight of an edge is the squared inverse document frequency of the word.
Means shrink the scale, so that after each round the scores of each language
are stretched back: the median scores of the clamped documents of levels 1 to 4
are mapped to 1 to 4, in between linearly.  A document's language is that of
most of its words, a word's that of most of its documents, as the given
language may be null or wrong.

Defined results: null, empty and word-less texts have no score and level null;
texts in a language without graded examples are placed on the scale of all
languages; a document that raters disagree on is not clamped, its text decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import cut, grouped_quantiles, table

#: Most rounds, and the mean change of a score at which the rounds end.
ROUNDS, STILL = 6, 0.01
LEVELS = (1, 2, 3, 4)
#: Graded documents that a level of a language must have to set its scale.
ENOUGH = 3


def edges(documents: DataFrame) -> DataFrame:
    """doc_id, word (a hash), e (weight), lang (given), for words of two documents or more."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.explode(words).alias("w")).where("w <> ''").select("doc_id", "lang", F.xxhash64("w").alias("word"))
    n = F.lit(float(max(2, documents.count())))
    df = rows.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where("df >= 2").select("word", F.pow(F.log(n / F.col("df")), F.lit(2.0)).alias("e"))
    return rows.join(df, "word").where("e > 0")


def language(graph: DataFrame) -> DataFrame:
    """doc_id, tongue: the language of most of the document's words."""
    per = graph.where("lang not in ('', 'und')").groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n"))
    own = per.groupBy("word").agg(F.max_by("lang", F.struct("n", "lang")).alias("tongue"))
    votes = graph.join(own, "word").groupBy("doc_id", "tongue").agg(F.sum("e").alias("v"))
    return votes.groupBy("doc_id").agg(F.max_by("tongue", F.struct("v", "tongue")).alias("tongue"))


def scale(scored: DataFrame) -> Column:
    """The expression that stretches score; scored: score, tongue, label.

    Collected are at most four medians of each language that has enough graded
    documents.
    """
    graded = scored.where("label is not null").withColumn("level", F.round("label").cast("int"))
    # Exact medians from counts of equal scores: no group is held in memory.
    enough = graded.where("score is not null").groupBy("tongue", "level").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ENOUGH)
    per = grouped_quantiles(graded, ["tongue", "level"], "score", 0.5, "m").join(enough, ["tongue", "level"]).collect()
    every = grouped_quantiles(graded, ["level"], "score", 0.5, "m").collect()
    knots: dict = {}
    for r in per:
        knots.setdefault(r["tongue"], {})[r["level"]] = r["m"]
    whole = {r["level"]: r["m"] for r in every}

    def line(k: dict) -> Column:
        pts = []
        for lv in sorted(k):
            pts.append((max(k[lv], pts[-1][0] + 1e-9) if pts else k[lv], float(lv)))
        if not pts:
            return F.col("score")
        x = F.col("score")
        out = F.lit(pts[-1][1])
        for (x0, y0), (x1, y1) in reversed(list(zip(pts, pts[1:]))):
            out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
        return F.when(x <= pts[0][0], F.lit(pts[0][1])).otherwise(out)

    out = line(whole)
    for tongue, k in knots.items():
        if tongue is not None and len(k) >= 2:
            # A level without enough examples lies where it lies for all languages, moved as the language's other levels are.
            move = sum(k[lv] - whole[lv] for lv in k) / len(k)
            k = {lv: k.get(lv, m + move) for lv, m in whole.items()}
            out = F.when(F.col("tongue") == tongue, line(k)).otherwise(out)
    return out


def difficulty(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, score (1 to 4, continuous) of every document that has words."""
    graph = cut(edges(documents))
    agreed = labels.where("doc_id is not null and reading_level between 1 and 4").groupBy("doc_id").agg(F.min("reading_level").alias("lo"), F.max("reading_level").alias("hi")).where("lo = hi").select("doc_id", F.col("lo").cast("double").alias("label"))
    docs = cut(graph.select("doc_id").distinct().join(language(graph), "doc_id", "left").join(agreed, "doc_id", "left"))
    graph = graph.select("doc_id", "word", "e")
    speak = docs.where("label is not null").select("doc_id", F.col("label").alias("s"))
    before = None
    for _ in range(rounds):
        words = graph.join(speak, "doc_id").groupBy("word").agg((F.sum(F.col("e") * F.col("s")) / F.sum("e")).alias("ws"))
        score = graph.join(words, "word").groupBy("doc_id").agg((F.sum(F.col("e") * F.col("ws")) / F.sum("e")).alias("score"))
        now = docs.join(score, "doc_id", "left")
        now = cut(now)
        now = now.withColumn("s", F.coalesce(scale(now), F.lit(2.0)))
        speak = now.select("doc_id", F.coalesce("label", "s").alias("s"))
        if before is not None:
            moved = now.select("doc_id", "s").join(before, "doc_id").agg(F.avg(F.abs(F.col("s") - F.col("b"))).alias("d")).first()["d"]
            if moved is None or moved < STILL:
                break
        before = now.select("doc_id", F.col("s").alias("b"))
    return now.select("doc_id", F.when(F.col("score").isNotNull(), F.col("s")).alias("score"))


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, reading_level of every document; both null where the text has no words."""
    s = difficulty(documents, labels)
    return documents.select("doc_id").join(s, "doc_id", "left").select("doc_id", F.round("score", 4).alias("score"), F.when(F.col("score").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(4), F.round("score")))).cast("int").alias("reading_level"))


def p10_levels(spark, folder):
    return levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


def p10_found(spark, folder):
    docs = table(spark, folder, "documents")
    long_ = docs.where("source is null or source <> 'spec_sheet'").where(F.size(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != "")) >= 40).select("doc_id")
    return levels(docs, table(spark, folder, "reading_labels")).join(long_, "doc_id", "left_semi").select("doc_id", "reading_level")
