"""Listings as sets of weighted tokens: the common ground of same-product grouping and linkage.

``learn`` reads from the titles which phrases only advertise and which words
belong together; ``parse`` splits every title (``titles``); ``blocks`` puts the
stated variant (accessory, colours, sizes, numbers in base units) into one
key.  What remains are words and model codes.

What a token is worth is learned from the titles that state a model code: how
much likelier two titles that share the token are to have one code than any two
titles, as a squared logarithm (``statistics``).  Words that
advertise come out at nothing, words of an article or a brand in between, words
that name a product high.

Words of a name that many products share tell little each, and the more
products there are, the less.  So two rare words that follow one another are a
token too (``paired``), and may be misspelt as a word may.

``complete`` adds to titles without a code the code that their words stand for
elsewhere, as one more token, round after round until no title gains one.

Nulls: listings without key or title are left out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.titles import Lexicon, Parser
from weft.session import cut

PARSED = "key string, variant string, code string, c long, dims array<string>, sizes array<double>, words array<string>, hs array<long>"
#: Dimensions that count and are compared exactly.
COUNTS = ("n", "shoe")
#: Values further apart than this ratio are different variants.
SAME = 1.045
#: A learned phrase stands in this share of the titles at least, so that there are at most 1 / FREQUENT of them for each word of a title.
FREQUENT = 0.002
#: Share of a word's titles in which it follows the word that it belongs to.
BOUND = 0.9
#: A word speaks for a code that this share of its coded titles bears; least sum of the shares, and least lead over the next code.
SPEAKS, ACCEPT, LEAD = 0.1, 0.5, 0.2
#: What the share of a word one letter off counts.
OFF = 0.8
#: Share of the coded rows from which on a word is no part of a name of several words.
NAME = 0.001
#: A word of a pair that no coded row has is taken for one that is one letter off and this many times as frequent.
RARER = 8
#: Share of the coded rows in which a token is common.
COMMON = 0.0001
#: Rounds of completion after which a call fails.
GUARD = 100


def learn(titles: DataFrame, frequent: float = FREQUENT) -> Lexicon:
    """The lexicon of a column title: every row counts.

    Collected are phrases in at least frequent of all rows only, a bounded number.
    """
    low = F.lower("title")
    phrase = F.regexp_extract_all(low, F.lit(r"(?<![a-z0-9'])(?:for|small|medium|large)[^a-z0-9]+[a-z]+|[a-z]+ flavou?r(?![a-z])"), F.lit(0))
    n = titles.count()
    least = max(3.0, frequent * n)
    cue = low.contains("flavo") | low.contains("small") | low.contains("medium") | low.contains("large") | low.contains("for ")
    seen = titles.where(cue).select(F.explode(phrase).alias("p")).select(F.regexp_replace("p", "[^a-z]+", " ").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.lit(least if n else 1.0) / 4).collect()
    pairs = {tuple(r["p"].split(" ")): r["n"] for r in seen if r["p"].count(" ") == 1}
    stock = frozenset(b for (a, b), k in pairs.items() if a == "for" and k >= least)
    flavours = frozenset(a for (a, b) in pairs if b in ("flavour", "flavor"))
    close = {p: k for p, k in pairs.items() if p[0] in ("small", "medium", "large") and k >= least}
    compounds = frozenset()
    if close:
        words = "|".join(sorted({b for _, b in close}))
        any_ = functools.reduce(lambda a, b: a | b, [low.contains(w) for w in sorted({b for _, b in close})])
        every = titles.where(any_).select(F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?<![a-z])(?:{words})(?![a-z])"), F.lit(0)))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
        total = {r["w"]: r["n"] for r in every}
        compounds = frozenset(p for p, k in close.items() if k >= BOUND * total.get(p[1], k))
    return Lexicon(compounds=compounds, stock=stock, flavours=flavours)


def parse(listings: DataFrame, lexicon: Lexicon | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """listings: key, title, model (a code from elsewhere, or null) -> PARSED and the columns keep, which pass through untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(lexicon)
        known: dict[str, int] = {}

        def hashed(w: str) -> int:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w.encode(), seed=42)
                h = h - (1 << 64) if h >= 1 << 63 else h
                if len(known) < 500_000:
                    known[w] = h
            return h

        def lists(ends: list[int], values: list, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))

        for b in batches:
            variants, codes, cs, dims, sizes, words, hs = [], [], [], [], [], [], []
            # Lists are filled one after another, and cut where a row ends.
            d_ends, w_ends, h_ends = [0], [0], [0]
            for title, model in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                acc, code, names, d, w = parser.parse(title)
                if not code and model:
                    code = model.lower().replace("-", "").replace(" ", "")
                    if code not in w:
                        w.append(code)
                variants.append(f"{acc}/{' '.join(names)}" if acc or names else "")
                codes.append(code)
                cs.append(hashed(code))
                for x, v in d:
                    dims.append(x)
                    sizes.append(v)
                words += w
                own = [*map(known.get, w)]
                hs += sorted({hashed(x) for x in w} if None in own else set(own))
                d_ends.append(len(dims))
                w_ends.append(len(words))
                h_ends.append(len(hs))
            columns = [pa.array(variants, pa.string()), pa.array(codes, pa.string()), pa.array(cs, pa.int64()), lists(d_ends, dims, pa.string()), lists(d_ends, sizes, pa.float64()), lists(w_ends, words, pa.string()), lists(h_ends, hs, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, *[b.column(3 + i) for i in range(len(keep))]], names=["key", "variant", "code", "c", "dims", "sizes", "words", "hs", *keep])

    of = dict(listings.dtypes)
    return listings.select("key", "title", "model", *keep).mapInArrow(run, ", ".join([PARSED, *[f"{c} {of[c]}" for c in keep]]))


def cuts(parsed: DataFrame) -> dict[str, list[float]]:
    """For each measured dimension, where its values leave a gap wider than SAME.

    There are at most 53 gaps to a decade, so the result is small whatever the
    number of rows.
    """
    v = parsed.select(F.explode(F.arrays_zip("dims", "sizes")).alias("x")).select(F.col("x.dims").alias("d"), F.col("x.sizes").alias("v")).groupBy("d", "v").agg(F.count(F.lit(1)).alias("n")).where(~F.col("d").isin(*COUNTS) & (F.col("v") > 0))
    v = v.groupBy("d", F.expr("round(v / pow(10, floor(log10(v)) - 2)) * pow(10, floor(log10(v)) - 2)").alias("v")).count()
    gaps = v.withColumn("p", F.lag("v").over(W.partitionBy("d").orderBy("v"))).where(F.col("v") > F.col("p") * SAME)
    out: dict[str, list[float]] = {}
    for r in gaps.select("d", F.sqrt(F.col("v") * F.col("p")).alias("c")).orderBy("d", "c").collect():
        out.setdefault(r["d"], []).append(r["c"])
    return out


def place(value: Column, at: list[float], low: int = 0) -> Column:
    """How many of the sorted numbers at are no greater than the value, by halving."""
    if not at:
        return F.lit(low)
    i = len(at) // 2
    return F.when(value < at[i], place(value, at[:i], low)).otherwise(place(value, at[i + 1 :], low + i + 1))


def blocks(parsed: DataFrame) -> DataFrame:
    """variant, dims and sizes become block (a hash), equal for listings of one accessory kind and variant."""
    at = cuts(parsed)

    def token(name: Column, value: Column) -> Column:
        out = F.when(name.isin(*COUNTS), F.concat(name, value.cast("string")))
        for d, cs in sorted(at.items()):
            out = out.when(name == d, F.concat(name, place(value, [float(c) for c in cs]).cast("string")))
        return out.otherwise(F.concat(name, F.lit("0")))

    block = F.when((F.col("variant") == "") & (F.size("dims") == 0), F.lit(0)).otherwise(F.xxhash64("variant", F.array_sort(F.array_distinct(F.zip_with("dims", "sizes", token)))))
    return parsed.withColumn("block", block).drop("variant", "dims", "sizes")


def frequent(stat: DataFrame, rows: int, share: float = NAME) -> list[int]:
    """h of the words that share of the coded rows have, at most 1 / share for each word of a title."""
    return [r["h"] for r in stat.where(F.col("n") >= max(2.0, share * rows)).select("h").collect()]


def once(value: Column, then) -> Column:
    """then(value) with value worked out once, however often then names it; Spark would work it out each time."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def neighbours(words: Column, both) -> Column:
    """both(word, next word) for all words of an array but the last."""

    def zipped(words: Column) -> Column:
        rest = F.greatest(F.size(words) - 1, F.lit(0))
        return F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), both)

    return once(words, zipped)


def pair(a: Column, b: Column) -> Column:
    """The token of two words (hashes) in either order."""
    return F.xxhash64(F.least(a, b), F.greatest(a, b))


def paired(often: list[int]) -> Column:
    """The tokens of any two words of a row (words, c) between which only frequent words or its code stand."""
    telling = F.filter(F.transform("words", lambda w: F.xxhash64(w)), lambda h: ~h.isin(often) & (h != F.col("c")))
    return F.array_distinct(neighbours(telling, pair))


def borne(rows: DataFrame, tokens: str = "hs") -> DataFrame:
    """h, c, m: how many of the rows that state the code (c, its hash) have the token (h)."""
    return rows.where("code <> ''").select("c", F.explode(tokens).alias("h")).groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"))


def chance(seen: DataFrame) -> float:
    """Share of the pairs of coded rows that have the same code; seen: borne() counts."""
    r = seen.where("h = c").agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1)).alias("p")).first()
    n = r["n"] or 0
    return max(1, r["p"] or 0) / (n * (n - 1)) if n > 1 else 0.5


def statistics(seen: DataFrame, base: float) -> DataFrame:
    """h, n (coded rows that have the token), w (its worth), purity (share of the pairs of its rows that have one code).

    The worth is the squared logarithm of how much likelier two rows that share
    the token are to have one code than any two rows (base).  A token of one row
    counts as half as telling as it can be.
    """
    n = F.col("n")
    s = seen.groupBy("h").agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1)).alias("together"))
    lift = F.greatest(F.lit(0.0), F.log((F.col("together") + 0.5) / (n * (n - 1) + 1) / base))
    return s.select("h", "n", (lift * lift).cast("float").alias("w"), ((F.col("together") + 0.0) / F.greatest(n * (n - 1), F.lit(1))).cast("float").alias("purity"))


def fresh(base: float) -> float:
    """The worth of a token that no coded row has."""
    return max(0.0, math.log(0.5 / base)) ** 2


def spelt(word: Column) -> Column:
    """Whether misspellings of a word are looked for."""
    return word.rlike("^[a-z]{4,}$")


def spellings(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """of, h: the known words (token, h) one letter off (one swap counts) from each of the unknown words (token, h).

    Both sides are joined on what is left of a word without one of its letters (its
    hash, as the words are compared after), which finds every such pair.  If both have n (how often a word stands), only words
    RARER times as frequent are found, and n of the unknown word is kept.
    """
    counted = ["n"] if "n" in unknown.columns and "n" in known.columns else []
    less = lambda c: F.array_distinct(F.concat(F.array(F.xxhash64(c)), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.xxhash64(F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.lit(1 << 20)))))))
    a = unknown.where(spelt(F.col("token"))).select("token", "h", *counted, F.explode(less("token")).alias("d"))
    b = known.where(spelt(F.col("token"))).select(F.col("token").alias("meant"), F.col("h").alias("m"), *[F.col(c).alias("often") for c in counted], F.explode(less("token")).alias("d"))
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    edits = F.levenshtein("token", "meant", 2)
    both = a.join(b, "d")
    if counted:
        both = both.where(F.col("often") >= RARER * F.col("n"))
    return both.where((edits == 1) | ((edits == 2) & (F.length("token") == F.length("meant")) & (letters("token") == letters("meant")))).select(F.col("h").alias("of"), F.col("m").alias("h"), *counted).distinct()


def misspelt(unknown: DataFrame, known: DataFrame, stands: DataFrame) -> DataFrame:
    """h, c, share for the unknown words (token, h): what the known words one letter off stand for; stands: h, c, share."""
    return senses(spellings(unknown, known), stands)


def senses(near: DataFrame, stands: DataFrame) -> DataFrame:
    """h, c, share for the tokens of near (of, h): what the tokens that they may mean stand for."""
    return near.join(stands, "h").groupBy(F.col("of").alias("h"), "c").agg((F.max("share") * OFF).alias("share"))


def speaking(seen: DataFrame, n: DataFrame) -> DataFrame:
    """h, c, share of every code that a token speaks for; n: h, n of the tokens."""
    return seen.where("h <> c").join(n.select("h", "n"), "h").where(F.col("m") >= SPEAKS * F.col("n")).select("h", "c", (F.col("m") / F.col("n")).alias("share"))


def votes(flat: DataFrame, stands: DataFrame) -> DataFrame:
    """id, c of the open rows (flat: id, h) that get a code from the tokens that speak."""
    # A row's votes are few: they go to one place as they are and are added up there.
    score = flat.select("id", "h").join(stands, "h").select("id", "c", "share").repartition("id").groupBy("id", "c").agg(F.sum("share").alias("s"))
    # A row has at most 1 / SPEAKS codes for each of its words, and the like for each word one letter off.
    best = score.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "c")), asc=False), 1, 2).alias("b"))
    return best.where((F.col("b")[0]["s"] >= ACCEPT) & (F.col("b")[0]["s"] - F.coalesce(F.get("b", F.lit(1))["s"], F.lit(0.0)) >= LEAD)).select("id", F.col("b")[0]["c"].alias("c"))


def silent(stat: DataFrame, rows: int) -> DataFrame:
    """h of the frequent tokens that speak for no code: a share of SPEAKS of its rows makes a token's purity its square.

    At most 1 / COMMON tokens for each word of a title are that frequent, so that they may be broadcast.
    """
    return stat.where((F.col("n") >= max(2.0, COMMON * rows)) & (F.col("purity") < 0.5 * SPEAKS * SPEAKS)).select("h")


def meant(strange: DataFrame, near: DataFrame, stat: DataFrame) -> DataFrame:
    """of, h: the pairs that a strange pair (strange: h, a, b, its words) may mean, one word being misspelt; near: spellings() of counted words."""
    near = near.select(F.col("of").alias("u"), F.col("h").alias("v"))
    either = strange.select("h", F.col("a").alias("u"), F.col("b").alias("o")).unionByName(strange.select("h", F.col("b").alias("u"), F.col("a").alias("o")))
    return either.join(near, "u").select(F.col("h").alias("of"), pair(F.col("v"), F.col("o")).alias("h")).join(stat.select("h"), "h", "left_semi").distinct()


def complete(rows: DataFrame, seen: DataFrame, stat: DataFrame, often: list[int] | None = None, guard: int = GUARD) -> DataFrame:
    """id, c (hash of a code) of every row without a code that gains one.

    rows: id, code, c, words; seen, stat: borne() counts and statistics() of their words and pairs, written; often: frequent(), without which there are no pairs.  What a round
    gives speaks in the next, for the rows still open; of the counts, only those of their tokens are kept
    that speak, or that no row with a stated code has.
    Every round but the last gives a row a code, so that the rounds end; should they reach guard before,
    the call fails rather than leave codes out.
    """
    # The hash of the parser is Spark's.
    quiet = silent(stat, rows.where("code <> ''").count())
    token = lambda d: d.select("*", F.explode("words").alias("token")).withColumn("h", F.xxhash64("token"))
    named = F.filter("words", lambda w: once(F.xxhash64(w), lambda h: ~h.isin(often or []) & (h != F.col("c"))))
    two = rows.where("code = ''" if often is not None else "false").select("id", F.explode(neighbours(named, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("x")).select("id", "x.a", "x.b").withColumn("h", pair(F.xxhash64("a"), F.xxhash64("b")))
    # What stands in token is a word; a pair has its words in a and b.
    none = F.lit(None).cast("string")
    one = token(rows.where("code = ''").select("id", "words")).select("id", "token", none.alias("a"), none.alias("b"), "h").join(F.broadcast(quiet), "h", "left_anti")
    flat = cut(one.unionByName(two.select("id", none.alias("token"), "a", "b", "h")))
    stands = cut(speaking(seen.join(F.broadcast(quiet), "h", "left_anti"), stat))
    strange = lambda f: f.where("token is not null").select("token", "h").distinct().join(stat.select("h"), "h", "left_anti")
    odd = cut(flat.where("a is not null").select("h", "a", "b").distinct().join(stat.select("h"), "h", "left_anti"))
    words = odd.select(F.explode(F.array("a", "b")).alias("token")).select("token", F.xxhash64("token").alias("h"), F.lit(True).alias("part"))
    words = words.unionByName(flat.where("token is not null").select("token", "h", F.lit(False).alias("part"))).groupBy("token", "h").agg(F.max("part").alias("part"))
    # A word that coded rows have is looked up as part of a pair only.
    words = words.join(stat.select("h", "n"), "h", "left").where("n is null or part").select("token", "h", F.coalesce("n", F.lit(0)).alias("n"))
    # Part of a name may be a word that speaks for no code alone.
    mute = quiet if often is None else quiet.where(F.col("h").isin(often))
    known = token(rows.where("code <> ''").select("words")).where(spelt(F.col("token"))).join(F.broadcast(mute), "h", "left_anti").groupBy("token", "h").agg(F.count(F.lit(1)).alias("n"))
    off = cut(spellings(words, known))
    means = cut(meant(odd.select("h", F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")), off, stat))
    flat = flat.drop("a", "b")
    near = cut(senses(off.where("n = 0").select("of", "h").unionByName(means), stands))
    out = None
    for _ in range(guard):
        best = cut(votes(flat, stands.unionByName(near)))
        if best.isEmpty():
            return best if out is None else out
        out = best if out is None else out.unionByName(best)
        gained = cut(flat.join(best, "id").select("token", "h", "c"))
        flat = cut(flat.join(best, "id", "left_anti"))
        words = cut(flat.select("h").distinct().join(stat.select("h"), "h", "left_anti").unionByName(flat.select("h").join(stands.select("h"), "h", "left_semi").distinct()))
        more = gained.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"))
        seen = cut(seen.unionByName(more).join(words, "h", "left_semi").groupBy("h", "c").agg(F.sum("m").alias("m")))
        stands = speaking(seen, seen.groupBy("h").agg(F.sum("m").alias("n")))
        # Words that only the rows just gained have may be what an open row means.
        new = cut(gained.where("token is not null").join(stat.select("h"), "h", "left_anti").groupBy("token", "h", "c").agg(F.count(F.lit(1)).alias("m")))
        near = near.join(words, "h", "left_semi")
        if not new.isEmpty():
            fresh_ = new.join(new.groupBy("h").agg(F.sum("m").alias("n")), "h").select("h", "c", (F.col("m") / F.col("n")).alias("share"))
            near = near.unionByName(misspelt(strange(flat), new.select("token", "h").distinct(), fresh_))
        near = cut(near)
    raise RuntimeError(f"titles still gain codes after {guard} rounds")


def members(rows: DataFrame, share: float = NAME) -> tuple[DataFrame, DataFrame, float]:
    """(members, statistics() of words and pairs, chance()), both frames written.

    rows: parse() with block and any others, parse() written; share: of frequent().  members: key, block,
    code, hs (sorted hashes of the words and of the code, stated or completed), pairs (paired()), any
    others, and set_id, equal for equal block, stated code and tokens; listings without a word have none.
    """
    rows = rows.withColumn("id", F.xxhash64("key"))
    seen = cut(borne(rows))
    base = chance(seen)
    stat = cut(statistics(seen, base))
    often = frequent(stat, rows.where("code <> ''").count(), share)
    rows = rows.withColumn("pairs", paired(often))
    seen2 = cut(borne(rows, "pairs"))
    # A pair counts from two rows of one code on: one that a slip has made tells nothing.
    stat2 = cut(statistics(seen2, base).withColumn("w", F.when(F.col("purity") > 0, F.col("w")).otherwise(F.lit(0).cast("float"))))
    stat = stat.unionByName(stat2)
    found = complete(rows, seen.unionByName(seen2), stat, often)
    rows = rows.drop("c", "words")
    open_ = rows.where("code = ''").join(found, "id", "left").withColumn("hs", F.when(F.col("c").isNull(), F.col("hs")).otherwise(F.sort_array(F.array_union("hs", F.array("c"))))).drop("c")
    out = rows.where("code <> ''").unionByName(open_)
    out = out.withColumn("set_id", F.when(F.size("hs") > 0, F.xxhash64("block", "code", "hs"))).drop("id")
    return cut(out), stat, base


def tokens(member: DataFrame, *keep: str) -> DataFrame:
    """keep, h, single (whether it is a word, no pair) of every token of the members()."""
    return member.select(*keep, F.size("hs").alias("singles"), F.posexplode(F.concat("hs", "pairs")).alias("at", "h")).withColumn("single", F.col("at") < F.col("singles")).drop("singles", "at")


def gathered(flat: DataFrame, node: str, *keep: str) -> DataFrame:
    """node, keep, t (w and h of its tokens, the rarest first), total of weighted() rows of the nodes.

    keep is equal for all rows of a node.  A node's rows go to one place as they are
    and are sorted there; its set is then what lies between two ends, and equal tokens
    follow one another.  Collecting them would sort them twice and write them in between.
    """

    def lists(rows: pa.Table) -> pa.RecordBatch:
        at, h = rows.column(node).to_numpy(), rows.column("h").to_numpy()
        new = np.append(True, at[1:] != at[:-1])
        rows = rows.filter(pa.array(new | np.append(True, h[1:] != h[:-1]))).combine_chunks()
        at, w = rows.column(node).to_numpy(), rows.column("w").to_numpy()
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        one = lambda c: rows.column(c).combine_chunks()
        both = pa.StructArray.from_arrays([one("w"), one("h")], names=["w", "h"])
        t = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), both)
        return pa.RecordBatch.from_arrays([*[one(c).take(pa.array(starts)) for c in (node, *keep)], t, pa.array(np.add.reduceat(w.astype("float64"), starts))], names=[node, *keep, "t", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(0).to_numpy()
            start = int(np.searchsorted(at, at[-1]))
            # The last node of a batch may go on in the next one.
            if start or (held and held[-1].column(0)[0].as_py() != at[0]):
                yield lists(pa.Table.from_batches([*held, b.slice(0, start)]))
                held = []
            held.append(b.slice(start))
        if held:
            yield lists(pa.Table.from_batches(held))

    of = dict(flat.dtypes)
    rows = flat.select(node, *keep, "h", "w").repartition(node).sortWithinPartitions(node, F.desc("w"), F.desc("h"))
    return cut(rows.mapInArrow(run, ", ".join([*[f"{c} {of[c]}" for c in (node, *keep)], "t array<struct<w: float, h: bigint>>", "total double"])))


def weighted(flat: DataFrame, stat: DataFrame, base: float) -> DataFrame:
    """flat (h, single and others) with the worth w of each token; a pair that no coded row has tells nothing."""
    return flat.join(stat.select("h", "w"), "h", "left").withColumn("w", F.coalesce("w", F.when(F.col("single"), F.lit(fresh(base))).otherwise(0.0).cast("float")))


def sets(member: DataFrame, stat: DataFrame, base: float) -> DataFrame:
    """set_id, block, code, t (w and h of its tokens, the rarest first), total of every set; tokens worth nothing are left out."""
    flat = tokens(member.where("set_id is not null"), "set_id", "block", "code")
    return gathered(weighted(flat, stat, base).where("w > 0"), "set_id", "block", "code")


def rests(t: str, total: str) -> Column:
    """For every token of a set, the weight of itself and all that follow it."""
    none = F.struct(F.lit(0.0).alias("before"), F.array().cast("array<double>").alias("rests"))
    after = lambda a, x: F.struct((a["before"] + x["w"]).alias("before"), F.concat(a["rests"], F.array(F.col(total) - a["before"])).alias("rests"))
    return F.aggregate(t, none, after, lambda a: a["rests"])


def overlap(a: str, b: str) -> Column:
    """Weight of the tokens of a that b has too."""
    return once(F.col(f"{b}.h"), lambda hs: F.aggregate(F.filter(a, lambda x: F.array_contains(hs, x["h"])), F.lit(0.0), lambda s, x: s + x["w"]))


def listings(modern: DataFrame | None, third: DataFrame | None, legacy: DataFrame | None = None) -> DataFrame:
    """One row per listing key: key, title (of the latest row that has one), model (most frequent code in specifications, or null)."""
    parts = []
    if modern is not None:
        model = F.regexp_extract("specifications", r'"(?:mpn|part_number|model)": ?"([A-Za-z]{2,4}[- ]?[0-9]{3,5})"', 1)
        parts.append(modern.select(F.col("asin").alias("key"), "title", "updated_at", "row_no", F.when(model != "", model).alias("model")))
    none = F.lit(None).cast("string").alias("model")
    if third is not None:
        parts.append(third.select(F.col("item_code").alias("key"), F.col("item_name").alias("title"), "updated_at", "row_no", none))
    if legacy is not None:
        parts.append(legacy.select(F.col("product_sku").alias("key"), F.col("product_name").alias("title"), "updated_at", "row_no", none))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # Whole rows of one key are alike: equal titles are merged before the rest.
    rows = rows.where(F.col("key").isNotNull() & (F.trim("key") != "") & F.col("title").isNotNull() & (F.trim("title") != ""))
    return rows.groupBy("key").agg(F.max_by("title", F.struct("updated_at", "row_no")).alias("title"), F.max("model").alias("model"))
