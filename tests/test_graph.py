import random

import pytest
from pyspark.sql import functions as F

from weft.operators import domains as D
from weft.operators import graph as G
from weft.operators import matching as M
from weft.operators import pairs as P


def union_find(edges, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    nodes = {x for e in edges for x in e} | {999}
    got = G.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), spark.createDataFrame([(n,) for n in nodes], "n long"))
    assert {x["node"]: x["component"] for x in got.collect()} == union_find(edges, nodes)


def test_components_of_nothing(spark):
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_strong_components(spark):
    e = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)]
    got = {r["node"]: r["component"] for r in G.strong_components(spark.createDataFrame(e, "a int, b int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_cliques(spark):
    e = [(1, 2), (2, 3), (1, 3), (3, 4)]
    got = {tuple(r["clique"]) for r in G.cliques(spark.createDataFrame(e, "a int, b int")).collect()}
    assert got == {(1, 2, 3), (3, 4)}


def test_equivalence_classes(spark):
    idx = spark.createDataFrame([(0, "A", [(0, 1), (1, 2)]), (1, "B", [(0, 1), (2, 2)]), (2, "C", [(0, 2), (1, 4)])], "term_id long, term string, columns array<struct<column_id:int,n:long>>")
    classes, members = D.equivalence_classes(idx)
    got = {r["eq"]: ([tuple(c) for c in r["columns"]], r["n_terms"]) for r in classes.collect()}
    assert got == {0: ([(0, 3), (1, 6)], 2), 1: ([(0, 1), (2, 2)], 1)}
    assert sorted(map(tuple, members.collect())) == [(0, 0), (0, 2), (1, 1)]


def test_similar_strings_is_complete(spark):
    r = random.Random(4)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(120)})

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for least in (0.6, 0.75):
        want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if 1 - lev(a, b) / max(len(a), len(b)) >= least - 1e-9}
        got = P.similar_strings(spark.createDataFrame([(w,) for w in [*words, None, ""]], "v string"), least)
        assert {(x["a"], x["b"]) for x in got.collect()} == want


def test_clusters():
    sims = {("a", "b"): 0.9, ("a", "c"): 0.2, ("b", "c"): 0.3}
    assert M.upgma(["a", "b", "c"], sims, 0.5) == [["a", "b"], ["c"]]
    assert M.leader_clusters(["a", "b", "c"], sims, 0.5) == [["a", "b"], ["c"]]
    assert M.elbow([10, 4, 2, 1.5, 1]) == 1
    assert len(M.sweep(["a", "b", "c"], sims)) == 17


def test_numbered(spark):
    df = spark.createDataFrame([(f"{i:04d}",) for i in random.Random(2).sample(range(5000), 500)], "t string")
    got = D.numbered(df, "t", "i").orderBy("t").collect()
    assert [r["i"] for r in got] == list(range(500))
    assert D.numbered(df.limit(0), "t", "i").count() == 0
    assert F is not None
