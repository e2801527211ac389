"""Whitening, quality rules and phrases against their definitions."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrases, quality, quality_rules, whitening

DATA = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("x", "d", "place", "white", "n")})


def check_whitening(got, rows, components=8):
    """Every column against exact integers and a covariance of centred rows, by length of the vectors."""
    real = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    assert len(got) == sum(min(components, len(v)) for _, v in real)
    for d in {len(v) for _, v in real}:
        ids = [i for i, v in real if len(v) == d]
        x = [[int(math.floor(1024 * c)) + 100_000 for c in v] for _, v in real if len(v) == d]
        n, k = len(x), min(components, d)
        s = [sum(col) for col in zip(*x)]
        deviation = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
        centred = np.array(x, dtype=float) - np.array(s) / n
        e, vec = np.linalg.eigh(centred.T @ centred / n)
        e, vec = e[::-1][:k], vec[:, ::-1][:, :k]
        own = got[got.d == d]
        for c in range(k):
            part = own[own.component == c + 1]
            assert sorted(zip(part.vec_id, part.deviation)) == sorted(zip(ids, deviation)) and (part.n == n).all()
            wanted = sorted(zip(ids, centred @ vec[:, c] / math.sqrt(e[c])))
            found = sorted(zip(part.vec_id, part.whitened))
            assert any(np.allclose([w for _, w in found], sorted_by, atol=1e-8) for sorted_by in ([w for _, w in wanted], [w for _, w in sorted((i, -w) for i, w in wanted)]))
            assert np.allclose(part.explained, e[c] / (np.trace(centred.T @ centred) / n), rtol=1e-9)
        assert own.identity_error.nunique() == 1 and own.identity_error.iloc[0] < 1e-6


@pytest.mark.parametrize(("block", "columns"), [(1024, 256), (16, 5)])
def test_whitening_by_definition(spark, monkeypatch, block, columns):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", columns)
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (150, 12)) @ np.diag(np.arange(12, 0, -1) / 7)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(900, [0.0] * 12), (901, None), (902, [1.0, None] + [0.0] * 10), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, []), (906, base[3].tolist())]
    rows += [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(0, 2, (30, 3)))]
    df = vectors(spark, rows)
    got = whitening.whitened(df).toPandas()
    sizes = {i: len(v) for i, v in rows if v}
    check_whitening(got.assign(d=got.vec_id.map(sizes)), rows)


def test_whitening_of_given_vectors(spark):
    given = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in given.collect()]
    got = whitening.op12_whitening(spark, DATA).toPandas()
    sizes = {i: len(v) for i, v in rows if v}
    check_whitening(got.assign(d=got.vec_id.map(sizes)), rows)


def test_whitening_without_variance_and_of_nothing(spark):
    one = whitening.whitened(vectors(spark, [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])])).toPandas()
    assert len(one) == 9 and (one.whitened == 0).all() and (one.explained == 0).all() and (one.identity_error == 1).all() and (one.deviation == 0).all() and (one.n == 3).all()
    assert whitening.whitened(vectors(spark, [(1, None)])).count() == 0
    # a deviation beyond 64 bits is null, those of the same fit that are not are there
    far = whitening.whitened(vectors(spark, [(1, [3e9]), (2, [0.0])])).toPandas()
    assert far.deviation.isna().all() and sorted(far.whitened.round(9)) == [-1.0, 1.0]


def counts_by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = {}
    for i in range(len(words) - 4):
        runs.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", text)), "n_digits": len(re.findall("[0-9]", text)), "n_marks": len(re.findall("[!?]", text)),
        "n_single": sum(len(w) == 1 for w in words), "n_distinct": len(set(words)),
    }


def test_counts_by_definition():
    r = random.Random(5)
    pool = ["a", "b", "cc", "Été", "|", "x#y", "漢字", "A1!", "\u00a0", "\U0001f600"]
    texts = ["", " \n\t", "a b c d e a b c d e", "a b c d e f a b c d e", "one\none\n\n\n one\none \none", "x" * 70_000]
    texts += ["".join(r.choice(pool[: r.choice([2, 4, 10])]) + r.choice([" ", " ", "\n", "\t", "\r\n", "\x0b"]) for _ in range(r.choice([3, 9, 40, 400]))) for _ in range(300)]
    got = quality_rules.counts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert {c: int(got[c][i]) for c in quality_rules.COUNTS} == counts_by_definition(t), t[:80]


def test_rules_on_held_out_documents(spark):
    data = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = quality_rules.op11_quality_rules(spark, data).toPandas()
    texts = docs.toPandas()
    assert sorted(got.doc_id) == sorted(texts.doc_id)
    both = got.merge(texts, on="doc_id")
    for r in both.itertuples():
        wanted = counts_by_definition(r.text or "")
        assert {c: getattr(r, c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} == {c: wanted[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    held = docs.where(quality.held_out(F.col("doc_id"))).select("doc_id").toPandas()
    known = got.merge(labels.toPandas(), on="doc_id").merge(held, on="doc_id")
    known = known[~known.base_failed]
    assert len(known) > 50 and (known.kept == (known.quality == 1)).mean() > 0.95


def test_lists_are_learned_and_emitted_in_order(spark):
    r = np.random.default_rng(2)
    x = r.uniform(0, 1, (3000, 3))
    bad = ((x[:, 0] > 0.8) & (x[:, 1] <= 0.5)) | (x[:, 2] > 0.9)
    noisy = bad ^ (r.uniform(0, 1, 3000) < 0.01)
    names = ["upper", "digits", "marks"]
    rules = quality_rules.learn(x, noisy, names)
    found = np.zeros(3000, dtype=bool)
    for rule in rules:
        found |= rule.covers(x, names)
    assert (found == bad).mean() > 0.98 and {t.share for rule in rules for t in rule.thresholds} == set(names)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "i long, upper double, digits double, marks double")
    kept = {v.i: v.kept for v in df.select("i", quality_rules.verdict(rules).alias("kept")).collect()}
    assert [not kept[i] for i in range(3000)] == found.tolist()
    text = df.select(quality_rules.verdict(rules).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("CASE WHEN") == 1 and str(rules[0])
    assert quality_rules.learn(x, np.zeros(3000, dtype=bool), names) == []


def test_rules_of_odd_tables(spark):
    schema = "doc_id long, text string, n_words string, kept int, upper string"
    rows = [(1, None, "clash", 1, "u"), (1, "", "clash", 1, "u"), (None, "w " * 9, "c", 0, None), (2, " ".join(f"w{i}" for i in range(10)), "c", 0, None), (2, " ".join(f"w{i}" for i in range(10)), "c", 0, None), (3, "v " * 300_000, "c", None, None)]
    docs = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.judge(docs, none).collect()
    assert sorted((g.n_words, g.base_failed, g.kept) for g in got) == [(0, True, False), (0, True, False), (9, True, False), (10, False, True), (10, False, True), (300_000, True, False)]
    assert quality_rules.judge(docs.limit(0), spark.createDataFrame([(1, 1), (1, 0), (2, 7)], "doc_id long, quality int")).count() == 0


def phrases_by_definition(rows, least, longest, top):
    total, f = {}, {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] = total.get(lang, 0) + len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    some = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in some.items():
        cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        inside = any(w != words and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w))) and 100 * b >= 50 * a for (other, w), b in some.items() if other == lang)
        if not inside:
            score, _, l, r = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize(("longest", "shards", "held"), [(3, 4, 4_000_000), (4, 3, 50), (2, 1, 50)])
def test_phrases_by_definition(spark, monkeypatch, longest, shards, held):
    monkeypatch.setattr(phrases, "HELD", held)
    r = random.Random(4)
    pool = ["the", "The", "of", "new", "york", "city", "été", "漢", "a#b", "\u00a0", "x" * 300]
    rows = [(None, None), ("", "en"), ("one two", None), ("w " * 3000, "long")]
    for _ in range(150):
        words = [r.choice(pool[: r.choice([4, 7, 11])]) for _ in range(r.choice([1, 5, 40]))]
        rows.append(("".join(w + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r"]) for w in words), r.choice(["en", "en", "de", None])))
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("clash") for c in ("phrase", "h", "n", "shard", "size")}).repartition(5)
    got = [tuple(x) for x in phrases.collocations(docs, 6, longest, 25, shards).collect()]
    assert sorted(got) == phrases_by_definition(rows, 6, longest, 25) and len(got) > 30


def test_phrases_equal_sql_and_of_nothing(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    got = phrases.op13_phrases(spark, DATA).toPandas()
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(con.execute(phrases.ORACLE).fetchall()) and len(got) > 50
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert phrases.collocations(docs).count() == 0


def test_scores_pass_64_bits(spark):
    text = ("a b " * 2000 + ". ") * 1000  # 2,000,000 of each: the product of the counts has 13 digits, times a million 19
    got = phrases.collocations(spark.createDataFrame([(text, "x")] * 3, "text string, lang string"), longest=2).collect()
    a, b = 6_000_000, 6_000_000 - 3000
    assert [(g.phrase, g.a, g.l, g.r, g.score) for g in got] == [("a b", a, a, a, 10**6), ("b a", b, a, a, 10**6 * b * b // (a * a))]
