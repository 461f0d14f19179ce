"""Matching schemas: how alike tables and columns are, which columns are one, which tables belong together.

The inputs are one row per table and column (dataset, column, ordinal, type,
ratios): metadata, whose size is that of the schemas.  Scores are computed in
frames; the order-dependent greedy steps run on the driver over those scores.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import metrics
from weft.functions.text import name_tokens, stem

# Weights of the criteria of table similarity.
FILE_WEIGHTS = {"file_name": 0.15, "schema_length": 0.15, "column_names": 0.30, "data_types": 0.20, "value_patterns": 0.20}


def pairs_of_columns(columns: DataFrame) -> DataFrame:
    """All pairs of columns of different tables (the smaller dataset first), joined on their datasets' pair."""
    d = columns.select("dataset").distinct()
    p = d.selectExpr("dataset a", "1 o").join(d.selectExpr("dataset b", "1 o"), "o").where("a < b").drop("o")
    side = lambda s: columns.select(F.col("dataset").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns.columns if c != "dataset"])
    return p.join(side("a"), "a").join(side("b"), "b")


def basic_similarity(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """Half Ratcliff-Obershelp ratio of the names, 0.3 word Jaccard, 0.2 type compatibility."""
    return 0.5 * metrics.difflib_ratio(F.lower(a), F.lower(b)) + 0.3 * metrics.array_jaccard(name_tokens(a), name_tokens(b)) + 0.2 * metrics.type_compatibility(ta, tb, 0.85, 0.2, 0.1)


def column_similarities(columns: DataFrame) -> DataFrame:
    """a, b (datasets), column_a, column_b, ordinal_a, ordinal_b, type_a, type_b, sim."""
    p = pairs_of_columns(columns.select("dataset", "column", "ordinal", "type"))
    return p.withColumn("sim", F.round(basic_similarity(F.col("column_a"), F.col("column_b"), F.col("type_a"), F.col("type_b")), 6))


def best_matches(sims: DataFrame, least: float = 0.4) -> DataFrame:
    """For each column of a and table b the most similar column (ties: the first of b)."""
    w = W.partitionBy("a", "column_a", "b").orderBy(F.desc("sim"), "ordinal_b")
    return sims.where(F.col("sim") >= least).withColumn("k", F.row_number().over(w)).where("k = 1").select("a", "column_a", "b", "column_b", "sim")


def mutual_matches(sims: DataFrame, least: float = 0.4) -> DataFrame:
    """Pairs of columns that are each other's most similar."""
    wa = W.partitionBy("a", "column_a", "b").orderBy(F.desc("sim"), "ordinal_b")
    wb = W.partitionBy("b", "column_b", "a").orderBy(F.desc("sim"), "ordinal_a")
    s = sims.where(F.col("sim") >= least).withColumn("ka", F.row_number().over(wa)).withColumn("kb", F.row_number().over(wb))
    return s.where("ka = 1 and kb = 1").select("a", "column_a", "b", "column_b", "sim")


def value_overlap(a: Column, b: Column) -> Column:
    """Common values over the smaller set."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))), F.lit(0.0))


def groups_from_reference(columns: list[tuple], sims: dict, reference: str, least: float = 0.4) -> list[dict]:
    """Column groups around the columns of a reference table.

    columns: (dataset, column, ordinal, type).  Every column of the reference
    takes its best column of each other table at least least alike; a column
    that two want goes to the more similar (ties: the earlier) and the other
    gets none.  Groups without a member are dropped.
    """
    ref = sorted((c for c in columns if c[0] == reference), key=lambda c: c[2])
    want: dict = {}
    for i, r in enumerate(ref):
        for d in sorted({c[0] for c in columns} - {reference}):
            mine = [(sims.get(frozenset([(reference, r[1]), (d, c[1])]), 0.0), -c[2], c) for c in columns if c[0] == d]
            s, _, c = max(mine, default=(0.0, 0, None))
            if c is not None and s >= least:
                held = want.get(c[:2])
                if held is None or s > held[0]:
                    want[c[:2]] = (s, i, c)
    out = []
    for i, r in enumerate(ref):
        got = [(s, c) for s, j, c in want.values() if j == i]
        if got:
            out.append({"reference": r, "members": sorted(got, key=lambda x: (x[1][0], x[1][2])), "confidence": float(np.mean([s for s, _ in got]))})
    return out


def golden_schema(groups: list[dict]) -> list[tuple]:
    """(ordinal, golden name, type, confidence, members) of each group.

    The name is the one that half of the group or more bear, else the
    reference's; the type the most frequent (ties: the reference's first, then
    in order).  Equal names get a number.
    """
    out, used = [], {}
    for i, g in enumerate(groups):
        all_ = [g["reference"], *[c for _, c in g["members"]]]
        names = [c[1].lower() for c in all_]
        best = max(dict.fromkeys(names), key=names.count)
        name = best if names.count(best) * 2 >= len(names) else g["reference"][1]
        used[name] = used.get(name, 0) + 1
        name = name if used[name] == 1 else f"{name}_{used[name]}"
        types = [c[3] for c in all_]
        out.append((i, name, max(dict.fromkeys(types), key=types.count), round(g["confidence"], 6), [f"{c[0]}.{c[1]}" for c in all_]))
    return out


def file_name_similarity(a: Column, b: Column) -> Column:
    return metrics.array_jaccard(name_tokens(stem(a)), name_tokens(stem(b)))


def table_similarities(columns: DataFrame) -> DataFrame:
    """a, b and the five criteria with their weighted sum.

    columns: dataset, column, ordinal, type, alpha_ratio, digit_ratio,
    special_ratio, space_ratio, unique_ratio.
    """
    share = lambda t: F.avg(F.col("type").isin(*t).cast("int"))
    shapes = columns.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), share(["string"]).alias("s"), share(["integer", "float"]).alias("m"), share(["datetime"]).alias("t"), F.avg("digit_ratio").alias("d"), F.avg("unique_ratio").alias("u"))
    x = shapes.selectExpr("dataset a", "n na", "s sa", "m ma", "t ta", "d da", "u ua", "1 o").join(shapes.selectExpr("dataset b", "n nb", "s sb", "m mb", "t tb", "d db", "u ub", "1 o"), "o").where("a < b")
    like = lambda p: 1 - F.abs(F.col(f"{p}a") - F.col(f"{p}b"))
    x = x.withColumn("file_name", file_name_similarity(F.col("a"), F.col("b"))).withColumn("schema_length", 0.7 * (1 - F.abs(F.col("na") - F.col("nb")) / F.greatest("na", "nb")) + 0.1 * (like("s") + like("m") + like("t")))
    p = pairs_of_columns(columns)
    sim = basic_similarity(F.col("column_a"), F.col("column_b"), F.col("type_a"), F.col("type_b"))
    ratios = ["alpha_ratio", "digit_ratio", "special_ratio", "space_ratio"]
    chars = sum((1 - F.abs(F.col(f"{r}_a") - F.col(f"{r}_b")) for r in ratios), F.lit(0.0)) / 4
    pattern = (chars + (1 - F.abs(F.col("digit_ratio_a") - F.col("digit_ratio_b"))) + (1 - F.abs(F.col("unique_ratio_a") - F.col("unique_ratio_b")))) / 3
    rows = p.select("a", "b", "ordinal_a", "ordinal_b", sim.alias("sim"), metrics.type_compatibility(F.col("type_a"), F.col("type_b")).alias("ty"), pattern.alias("pa")).where("sim > 0.3").orderBy("a", "b", "ordinal_a", "ordinal_b").collect()
    by: dict = {}
    for r in rows:
        by.setdefault((r["a"], r["b"]), []).append(r)
    out = []
    for r in x.select("a", "b", "na", "nb", "file_name", "schema_length", ((like("d") + like("u")) / 2).alias("whole")).collect():
        # Greedy: the columns of a in order take the best column of b that is left.
        taken, got = set(), []
        mine: dict = {}
        for c in by.get((r["a"], r["b"]), []):
            mine.setdefault(c["ordinal_a"], []).append(c)
        for i in sorted(mine):
            free = [c for c in mine[i] if c["ordinal_b"] not in taken]
            if free:
                best = max(free, key=lambda c: (c["sim"], -c["ordinal_b"]))
                taken.add(best["ordinal_b"])
                got.append(best)
        names = float(np.mean([c["sim"] for c in got])) * len(got) / max(r["na"], r["nb"]) if got else 0.0
        v = {"file_name": r["file_name"], "schema_length": r["schema_length"], "column_names": names, "data_types": float(np.mean([c["ty"] for c in got])) if got else 0.5, "value_patterns": float(np.mean([c["pa"] for c in got])) if got else r["whole"]}
        out.append((r["a"], r["b"], *[round(v[k], 6) for k in FILE_WEIGHTS], round(sum(w * v[k] for k, w in FILE_WEIGHTS.items()), 6)))
    return columns.sparkSession.createDataFrame(sorted(out), "a string, b string, " + ", ".join(f"{k} double" for k in FILE_WEIGHTS) + ", similarity double")


def upgma(names: list[str], sims: dict[tuple[str, str], float], least: float) -> list[list[str]]:
    """Average linkage over distances 1 - similarity, cut where the mean similarity of two clusters falls below least; largest clusters first."""
    s = lambda a, b: sims.get((a, b), sims.get((b, a), 0.0))
    parts = [[n] for n in sorted(names)]
    while len(parts) > 1:
        best = max(((float(np.mean([s(a, b) for a in parts[i] for b in parts[j]])), -i, -j) for i in range(len(parts)) for j in range(i + 1, len(parts))))
        if best[0] < least:
            break
        i, j = -best[1], -best[2]
        parts[i] = sorted(parts[i] + parts.pop(j))
    return sorted(parts, key=lambda p: (-len(p), p))


def silhouette(parts: list[list[str]], sims: dict[tuple[str, str], float]) -> float:
    """Mean over members of (b - a) / max(a, b), from distances to the own and the nearest other cluster; 0 for single members."""
    d = lambda a, b: 1 - sims.get((a, b), sims.get((b, a), 0.0))
    out = []
    for p in parts:
        for m in p:
            if len(p) == 1 or len(parts) == 1:
                out.append(0.0)
                continue
            a = np.mean([d(m, o) for o in p if o != m])
            b = min(np.mean([d(m, o) for o in q]) for q in parts if q is not p)
            out.append(float((b - a) / max(a, b)) if max(a, b) > 0 else 0.0)
    return float(np.mean(out)) if out else 0.0


def quality(parts: list[list[str]], sims: dict[tuple[str, str], float]) -> tuple[float, float]:
    """Mean similarity inside clusters (1 for single members) and between them (0 for one cluster)."""
    s = lambda a, b: sims.get((a, b), sims.get((b, a), 0.0))
    inside = [np.mean([s(a, b) for i, a in enumerate(p) for b in p[i + 1 :]]) if len(p) > 1 else 1.0 for p in parts]
    across = [s(a, b) for i, p in enumerate(parts) for q in parts[i + 1 :] for a in p for b in q]
    return float(np.mean(inside)), float(np.mean(across)) if across else 0.0


def sweep(names: list[str], sims: dict[tuple[str, str], float]) -> list[tuple]:
    """(threshold, clusters, quality, silhouette, balance, score) for thresholds 0.1 to 0.9: 0.4 quality, 0.3 silhouette, 0.2 balance, 0.1 / clusters."""
    out = []
    for k in range(17):
        t = round(0.1 + 0.05 * k, 2)
        p = upgma(names, sims, t)
        inside, across = quality(p, sims)
        q, s = max(0.0, inside - across), silhouette(p, sims)
        sizes = [len(x) for x in p]
        balance = 1 - float(np.std(sizes) / np.mean(sizes)) if np.mean(sizes) else 0.0
        out.append((t, len(p), round(q, 6), round(s, 6), round(balance, 6), round(0.4 * q + 0.3 * s + 0.2 * max(0.0, balance) + 0.1 / len(p), 6)))
    return out


def elbow(values: list[float]) -> int:
    """Index of the point farthest from the line between the ends."""
    n = len(values)
    if n < 3:
        return 0
    x, y = np.arange(n), np.array(values, float)
    dx, dy = n - 1, y[-1] - y[0]
    return int(np.argmax(np.abs(dy * x - dx * (y - y[0])) / np.hypot(dx, dy)))


def leader_clusters(names: list[str], sims: dict[tuple[str, str], float], least: float) -> list[list[str]]:
    """Single pass: a name joins the first cluster whose leader is alike enough, or leads a new one."""
    out: list[list[str]] = []
    for n in names:
        home = next((c for c in out if sims.get((c[0], n), sims.get((n, c[0]), 0.0)) >= least), None)
        home.append(n) if home else out.append([n])
    return out


def tfidf_columns(columns: DataFrame) -> DataFrame:
    """a, b, sim: cosine of the names' words (one to three in a row) weighted by smoothed inverse document frequency."""
    t = columns.select(F.concat_ws(".", "dataset", "column").alias("id"), name_tokens(F.col("column")).alias("t"))
    grams = lambda k: F.when(F.size("t") >= k, F.transform(F.sequence(F.lit(1), F.size("t") - (k - 1)), lambda i: F.array_join(F.slice("t", i, k), " "))).otherwise(F.array().cast("array<string>"))
    w = t.select("id", F.explode(F.concat(grams(1), grams(2), grams(3))).alias("g")).groupBy("id", "g").agg(F.count(F.lit(1)).alias("tf"))
    n = t.count()
    df = w.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    w = w.join(df, "g").withColumn("w", F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    w = w.join(norm, "id").select("id", "g", (F.col("w") / F.col("n")).alias("w"))
    return w.selectExpr("id a", "g", "w wa").join(w.selectExpr("id b", "g", "w wb"), "g").where("a <> b").groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("sim"))


def dataset_matrix(columns: DataFrame) -> DataFrame:
    """a, b, sim: the mean over a's columns of their best column of b; not symmetric."""
    s = tfidf_columns(columns).select(F.substring_index("a", ".", 1).alias("da"), "a", F.substring_index("b", ".", 1).alias("db"), "sim").where("da <> db")
    best = s.groupBy("da", "a", "db").agg(F.max("sim").alias("m"))
    n = columns.groupBy(F.col("dataset").alias("da")).agg(F.count(F.lit(1)).alias("n"))
    return best.groupBy("da", "db").agg(F.sum("m").alias("m")).join(n, "da").select(F.col("da").alias("a"), F.col("db").alias("b"), F.round(F.col("m") / F.col("n"), 6).alias("sim"))


# Words in a column's name that tell its meaning.
MEANINGS = {
    "identifier": ("id", "sku", "asin", "code", "number"),
    "name": ("name", "title"),
    "contact": ("email", "phone", "contact"),
    "address": ("address", "city", "state", "zip", "postal", "country"),
    "date": ("date", "time", "created", "signup", "registration", "timestamp"),
    "price": ("price", "amount", "cost", "total", "retail", "current"),
    "quantity": ("quantity", "qty", "count", "inventory", "stock"),
    "status": ("status", "active", "premium", "member", "prime", "loyalty", "availability"),
    "measurement": ("weight", "dimension", "lbs", "kg"),
    "category": ("category", "type", "subcategory"),
    "brand": ("brand", "manufacturer", "supplier", "seller"),
}


def meaning(name: str) -> str:
    """Every meaning one of whose words is in a column's name, in the table's order, joined by ", "; "other" if there is none."""
    low = name.lower()
    return ", ".join(k for k, ws in MEANINGS.items() if any(w in low for w in ws)) or "other"


def name_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()
