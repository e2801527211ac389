import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
DATA = "/root/testdata/sf0.001"


def lines_left(rows):
    """Line dedup by definition, on rows (doc_id, text)."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                first[key(line)] = min(i, first.get(key(line), i))
    return [(i, "\n".join(x for x in (t or "").split("\n") if i is None or first.get(key(x), i) == i)) for i, t in rows]


def heads_left(rows):
    """Rows (doc_id, text) of the smallest documents of components of near copies, by comparing all pairs."""

    def shingles(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
        w = [x for y in w for x in y.split() if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                a, b = find(i), find(j)
                root[a] = b
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    kept = {(d, t) for i, (d, t) in enumerate(rows) if d is not None and least[find(i)] == d}
    return sorted(kept, key=str) + [(d, t) for d, t in rows if d is None]


def test_stages_one_by_one(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, counts, texts = docs.columns, [docs.count()], []
    for name, stage in cp.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert docs.columns == names
            after = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
            texts.append(dict(after))
            if name == "line_dedup":
                assert sorted(after) == sorted(lines_left(before))
            elif name == "near_copies":
                assert sorted(after) == sorted(heads_left(before))
            else:
                assert set(after) <= set(before)
        counts.append(docs.count())
    quality = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id").quality
    assert all(quality.get(i, 1) == 1 for i in texts[0])
    assert counts[1] == counts[2] >= counts[3] and counts[4] == counts[5]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_on_odd_rows_and_none(spark, tmp_path):
    import corpus_pipeline as cp

    given = spark.read.parquet(f"{DATA}/documents.parquet")
    r = random.Random(1)
    long = " ".join(r.choice(["river", "stone", "under", "little", "evening"]) + str(r.randint(0, 999)) for _ in range(30_000))
    rows = [(None, "a line without an id\nother", "a"), (None, None, None), (900_001, None, "a"), (900_002, "", None), (900_003, long, "b"), (900_004, long + " end", "b"), (900_005, "x" * 100_000, "c"), (900_006, "one\ntwo", "a"), (900_006, "one\ntwo", "a"), (900_006, "three", "a")]
    odd = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], given.schema)
    clash = {c: F.lit("mine") for c in ("score", "predicted", "n_lines", "n_dropped", "copies", "target", "mark", "rep", "signature", "_n", "bucket")}
    docs = given.limit(60).unionByName(odd).withColumns(clash)
    for name, stage in cp.STAGES[1:4]:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        before = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == out.columns == [*given.columns, *clash]
        assert docs.where(" OR ".join(f"{c} <> 'mine' OR {c} IS NULL" for c in clash)).count() == 0
        after = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
        if name == "line_dedup":
            assert sorted(map(str, after)) == sorted(str((i, (t or "") if i is None else t)) for i, t in lines_left(before))
        elif name == "near_copies":
            assert sorted(map(str, after)) == sorted(map(str, heads_left(before)))
    assert cp.tokenise(spark, docs, DATA).count() == docs.count()
    good = cp.keep_good(spark, given.unionByName(odd).withColumns(clash), DATA)
    assert good.columns == [*given.columns, *clash] and good.where("score <> 'mine'").count() == 0 and 0 < good.count() < given.count() + len(rows)


def test_stages_of_nothing(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert [stage(spark, docs, DATA).count() for _, stage in cp.STAGES] == [0] * 5


@pytest.mark.parametrize("name", ["op5_line_dedup", "op7_mixing"])
def test_native_queries_equal_sql_and_need_no_python(spark, name):
    import duckdb

    from tidemark.llm import registry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    df = registry.QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    wanted = con.execute(registry.ORACLES[name])
    names = [c[0] for c in wanted.description]
    assert sorted(map(str, (tuple(x) for x in df.select(*names).collect()))) == sorted(map(str, wanted.fetchall()))
