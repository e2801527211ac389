import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, multi_index, near_vectors, ngram_join


def reach(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51)], [(random.Random(1).randrange(60), random.Random(i).randrange(60)) for i in range(50)]])
def test_components(spark, links):
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = reach(60, links)
    assert got == {i: wanted[i] for i in {x for p in links if p[0] != p[1] for x in p}}


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int")


def clusters(seed, n, d=64):
    r = np.random.default_rng(seed)
    x = [r.normal(size=d) for _ in range(n // 2)]
    while len(x) < n:
        base = x[r.integers(len(x) // 4 + 1)]
        x.append(base + r.normal(size=d) * r.choice([0.0, 0.05, 0.2, 0.4]))
    return [(7 * i + 3, np.float32(v)) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_by_brute_force(spark, block):
    rows = clusters(1, 600)
    got = {r.vec_id: r for r in near_vectors.near_duplicates(vectors(spark, rows), block=block).collect()}
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = np.triu(x @ x.T >= 0.9, 1)
    i, j = np.nonzero(near)
    count = near.sum(0) + near.sum(1)
    found = sum(got[k].n_links for k, _ in rows)
    assert found >= 0.98 * count.sum() and all(got[k].n_links <= c for (k, _), c in zip(rows, count))
    root = reach(len(rows), list(zip(i.tolist(), j.tolist())))
    same = [got[k].component_id == rows[r][0] for (k, _), r in zip(rows, root)]
    assert np.mean(same) >= 0.99
    assert all(g.kept == (k == g.component_id) for k, g in got.items())


@pytest.mark.parametrize("d", [64, 256, 768])
def test_near_vectors_at_the_threshold(spark, d):
    r = np.random.default_rng(d)
    rows = []
    for i in range(1000 if d < 100 else 300):  # pairs just above the threshold, which are the hardest to find
        x, z = r.normal(size=(2, d))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        z /= np.linalg.norm(z)
        rows += [(2 * i, x), (2 * i + 1, 0.9001 * x + np.sqrt(1 - 0.9001**2) * z)]
    got = {g.vec_id: g.n_links for g in near_vectors.near_duplicates(vectors(spark, rows, "double")).collect()}
    assert all(n <= 1 for n in got.values()) and np.mean(list(got.values())) >= 0.99


def test_functions_and_tables_follow_size_and_dimension():
    assert [near_vectors.functions_for(64, n) for n in (1000, 10**6, 10**9)] == [2, 3, 4]
    few, more = near_vectors.tables_for(64, 2, 0.9), near_vectors.tables_for(64, 3, 0.9)
    assert few < more < near_vectors.MAX_TABLES and few < near_vectors.tables_for(256, 2, 0.9)


BAD = [(1000, None), (1001, [0.0] * 4), (1002, [float("nan")] + [1.0] * 3), (1003, [1.0, None, 0, 0]), (1004, []), (1005, [float("inf")] * 4)]


def test_near_vectors_odd_rows(spark):
    rows = [(1, [1, 0, 0, 0]), (2, [2, 0, 0, 0]), (3, [1, 0, 0]), (4, [1, 0, 0, 0]), (4, [1, 0, 0, 0]), (5, [1e-30, 0, 0, 0]), (6, [-1, 0, 0, 0])] + BAD
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(vectors(spark, rows, "double").withColumn("key", F.lit(1))).collect())
    wanted = [(1, 4, 1, True), (2, 4, 1, False), (3, 0, 3, True), (4, 4, 1, False), (4, 4, 1, False), (5, 4, 1, False), (6, 0, 6, True)] + [(k, 0, k, True) for k, _ in BAD]
    assert got == wanted
    assert near_vectors.near_duplicates(vectors(spark, [])).count() == 0
    long = [(i, np.random.default_rng(i % 2).normal(size=1024)) for i in range(4)]
    assert sorted(r.n_links for r in near_vectors.near_duplicates(vectors(spark, long).withColumn("bucket", F.lit("clash"))).collect()) == [1, 1, 1, 1]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(near_vectors.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(near_vectors.hadamard(near_vectors.hadamard(x)), x)


@pytest.mark.parametrize("bucket_rows", [8192, 60])
def test_multi_index_recall(spark, bucket_rows):
    rows = clusters(2, 900, 16)
    ask = F.col("vec_id") % 50 == 3
    got = {}
    for r in multi_index.search(vectors(spark, rows), ask, bucket_rows=bucket_rows, query_rows=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    x, ids = np.array([v for _, v in rows], dtype=np.float64), [k for k, _ in rows]
    hits = []
    for k, v in rows:
        if k % 50 == 3:
            d = sorted((s, i) for s, i in zip(np.sqrt(((x - np.float64(v)) ** 2).sum(1)).tolist(), ids) if i != k)[:10]
            assert got[k] == sorted(got[k]) and len(got[k]) == 10
            hits.append(len({i for _, i in d} & {i for _, i in got[k]}) / 10)
    assert np.mean(hits) >= 0.9
    # with all cells visited the result is exact, ties included
    every = multi_index.search(vectors(spark, rows), ask, visit=1.0, bucket_rows=bucket_rows).where(f"query_id = {k if (k := rows[0][0]) % 50 == 3 else rows[0][0]}")
    assert [r.vec_id for r in every.orderBy("rank").collect()] == [i for _, i in sorted((s, i) for s, i in zip(np.sqrt(((x - x[0]) ** 2).sum(1)).tolist(), ids) if i != rows[0][0])[:10]]


def test_multi_index_odd_rows(spark):
    rows = [(0, [1, 0, 0, 0]), (1, [1, 0, 0, 0]), (2, [1, 0, 0, 0]), (100, [0, 3, 0, 0]), (7, [1, 2, 3])] + BAD
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in multi_index.search(vectors(spark, rows, "double"), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 3.162278), (100, 1, 0, 3.162278), (100, 2, 1, 3.162278), (100, 3, 2, 3.162278)]
    assert multi_index.search(vectors(spark, BAD), F.col("vec_id") % 100 == 0).count() == 0


def test_walk_goes_by_summed_distance():
    r = np.random.default_rng(3)
    a, b, size = r.random(6), r.random(6), r.integers(0, 4, 36)
    got = multi_index.walk(a, b, size, int(size.sum()))
    sums = [a[c // 6] + b[c % 6] for c in got]
    assert sums == sorted(sums) and sorted(got) == np.flatnonzero(size).tolist()


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(3))
    out = [" ".join(word() for _ in range(r.choice([1, 2, 3, 4, 8, 60, 150]))) for _ in range(80)]
    passage = " ".join(word() for _ in range(60))
    while len(out) < 300:
        w = r.choice(out).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w) if r.random() < 0.8 else passage + " " + " ".join(w[:40]))
    return out + ["", None, "  ", "A b C d e", "a B c D e", out[9].upper()]


@pytest.mark.parametrize(("k", "percent", "chunk", "repeated", "slice"), [(4, 85, 96, 3, 1024), (5, 80, 4, 2, 2), (1, 60, 8, 10**6, 1024), (1, 60, 8, 2, 4)])
def test_ngram_join_by_brute_force(spark, monkeypatch, k, percent, chunk, repeated, slice):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "REPEATED", repeated)
    monkeypatch.setattr(ngram_join, "SLICE", slice)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts(k))]
    rows.append(rows[20])
    sets = [shingles(t, k) for _, t in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    wanted = sorted((i, len(s), rows[r][0]) for (i, _), s, r in zip(rows, sets, reach(len(rows), links)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = ngram_join.jaccard_components(docs, k, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == wanted


def test_postings_of_a_hot_token_are_cut_into_slices(spark):
    heads = spark.createDataFrame([(i, 9, [7, 10_000 + i // 2, 20_000 + i], [50, 1, 1]) for i in range(2000)], "doc_id long, n long, prefix array<long>, slices array<int>")
    found = ngram_join._postings(heads, 64).withColumn("part", F.spark_partition_id())
    kept = [found.where(c).count() for c in ("token = 7", "token between 10000 and 19999", "token >= 20000")]
    assert kept == [2000, 2000, 0]  # by all, by two each, by one each
    hot = [r["count"] for r in found.where("token = 7").groupBy("part").count().collect()]
    assert len(hot) > 20 and max(hot) < 400


def test_ngram_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(empty).count() == 0
    got = ngram_join.jaccard_components(spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got.where("doc_id IS NOT NULL").collect()) == [(1, 2, 1), (2, 0, 2)] and got.count() == 3


def test_ngram_join_of_odd_tables(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, long), (2, long + " end"), (2, long + " end"), (3, "x" * 200_000), (4, "x" * 200_000), (5, long[: len(long) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rep": F.lit("clash"), "n": F.lit(1), "signature": F.lit(None)})
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    assert [(i, c) for i, _, c in got] == [(1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (5, 5)] and got[0][1] == 49_997
