import hashlib
import html as htmllib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, html_extract, line_dedup, mixing, passage_dedup, pretokens, quality, token_counts

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text, source) as a documents table."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


LONG_LINE = "x" * 70_000 + " end"
ODD = [
    (1, None, "b"), (2, "", "b"), (3, "A common line of text\nown line of three\n\nshort", "a"), (4, "  a COMMON line of text\t\nshort\nshort", None),
    (5, "a common line of text", "a"), (5, "a common line of text", "a"), (7, LONG_LINE + "\n" + LONG_LINE, "c"), (8, LONG_LINE, "c"), (9, "\n\n \n", "d"), (10, "ÄÖÜ ä common\nÄÖÜ Ä common ", "d"),
]


def lines_by_definition(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_by_definition(spark):
    docs = documents(spark, ODD).withColumn("n_dropped", F.lit("clash"))
    got = line_dedup.kept_text(docs)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == lines_by_definition(ODD)
    assert line_dedup.kept_text(docs.limit(0)).count() == 0


def test_folded_lines_are_equal_only_without_ascii_case(spark):
    r = random.Random(3)
    letters = "aAbBzZ@[`{ éÉçÇ×÷ßẞÀàŸÿµªİıſKΣσςЖж़अ가힣\uffee😀𐐀𐐨" + chr(0x7FF) + chr(0x800) + chr(0xC0) + chr(0x10FFFF)
    texts = sorted({"".join(r.choice(letters) for _ in range(r.choice([1, 2, 3]))) for _ in range(6000)} | {chr(c) for c in range(0x80, 0x3000)})
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", line_dedup.folded(F.col("t")).alias("f")).collect()
    plain = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    assert len({g.f for g in got}) == len({plain(g.t) for g in got}) == len({(g.f, plain(g.t)) for g in got})


def test_one_line_over_many_ranges(spark):
    rows = [(i, f"the very common line\nown line number {i}\n" + "the very common line\n" * (i % 3), "s") for i in range(500)]
    got = line_dedup.kept_text(documents(spark, rows))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == lines_by_definition(rows)


def test_lines_are_dealt_and_sorted_once(spark):
    rows = line_dedup.hashed_lines(documents(spark, ODD + [(100 + i, "the one line that all of them hold", "s") for i in range(50)]))
    heavy = line_dedup.heavy_hashes(rows, 4)
    assert heavy.orderBy(F.desc("slices")).first().slices >= 10
    plan = line_dedup.streamed_firsts(rows, heavy, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan and plan.count("Sort [") == 1


def test_keep_bitmaps_agree_with_kept_texts(spark):
    docs = documents(spark, [(i, t, s) for i, t, s in ODD if i not in (5, 1)])
    kept = {r.doc_id: r for r in line_dedup.kept_text(docs).collect()}
    for r in line_dedup.keep_bitmaps(docs).collect():
        lines = next(t for i, t, _ in ODD if i == r.doc_id).split("\n")
        left = [x for k in r.keep for x in lines[k.start : k.start + k.length]]
        assert "\n".join(left) == kept[r.doc_id].text
        assert (r.n_lines, r.n_dropped) == (len(lines), len(lines) - len(left)) and r.n_dropped > 0


@pytest.mark.parametrize(("which", "level"), [("odd", 12), ("many", 12), ("many", 1), ("many", 2), ("empty", 12), ("no words", 12)])
def test_mixing_equals_sql(spark, monkeypatch, which, level):
    monkeypatch.setattr(mixing, "LEVEL_BITS", level)
    r = random.Random(2)
    rows = {
        "odd": ODD[:6] + [(20, "w " * 50, "e"), (21, "w", "e")], "empty": [], "no words": [(1, None, None), (2, " ", "a")],
        "many": [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 40))), r.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(3000)],
    }[which]
    docs = documents(spark, rows).withColumn("target", F.lit("clash"))
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.fair_queue(docs, rows_per_bucket=64).collect())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "int64", "text": "string", "source": "string"}))
    wanted = con.execute(mixing.ORACLE).fetchall() if rows else []
    if which == "odd":  # rows that repeat a doc_id come one by one here, together in SQL
        got = [g for g in got if g[0] != 5]
        wanted = [w for w in wanted if w[0] != 5]
    assert got == sorted((w[0], w[1], w[2], round(w[3], 6), w[4]) for w in wanted)
    if which == "many":
        by = {}
        for _, size, source_size, target, taken in got:
            assert taken in (0, size, 2 * size)
            by.setdefault((source_size, target), []).append(taken)
        assert all(abs(sum(t) - target) <= 80 for (_, target), t in by.items())
        assert abs(sum(target for _, target in by) - 1.5 * sum(s for s, _ in by)) < 1e-6


def test_mix_repeats_documents(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(40)] + [(None, "w w", "a")]
    plan = {r.doc_id: r.copies for r in mixing.fair_queue(documents(spark, rows)).collect()}
    got = mixing.mixed(documents(spark, rows).withColumn("copies", F.lit("clash"))).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {k: v for k, v in plan.items() if v}


def test_mix_of_rows_that_repeat_a_document(spark):
    r = random.Random(4)
    rows = [(i % 30, "w " * r.randint(1, 30) + f"x{i % 45}", "abc"[i % 3]) for i in range(120)] + [(7, "w w w", "a")] * 5 + [(None, "n n", None)] * 3
    docs = documents(spark, rows)
    queued = mixing.fair_queue(docs).collect()
    got = mixing.mixed(docs).groupBy("doc_id", "source", F.xxhash64("text").alias("mark")).count().collect()
    wanted = {}
    for q in queued:
        if q.copies:
            wanted[q.doc_id, q.source, q.mark] = wanted.get((q.doc_id, q.source, q.mark), 0) + q.copies
    assert {(g.doc_id, g.source, g.mark): g["count"] for g in got} == wanted


def passages(seed):
    """Rows with shared passages at the ends of lines and inside them, and common short sentences."""
    r = random.Random(seed)
    sentence = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)).capitalize() + "."
    shared = [" ".join(sentence(r.randint(5, 12)) for _ in range(7)) for _ in range(4)]
    rows = []
    for i in range(60):
        own = [sentence(r.randint(3, 12)) for _ in range(12)]
        if i % 3 == 0:
            own.insert(r.randrange(12), r.choice([*shared, shared[0].upper().replace(" ", "  ")]))
        own.insert(r.randrange(12), "All rights are reserved here.")
        rows.append((i, "".join(x + r.choice([" ", "\n", "\n\n"]) for x in own), "s"))
    return [*rows, (90, None, "s"), (91, "", "s"), (92, shared[0] + "\n" + shared[0], "s"), (92, shared[0] + "\n" + shared[0], "s"), (None, shared[0], "s")]


def test_passages_by_definition(spark):
    rows = passages(3)
    got = passage_dedup.repeated_passages(documents(spark, rows)).collect()
    seen, wanted = {}, set()
    for i, t, _ in rows:
        run, words, last = [], 0, None
        if i is None or last == i:
            continue
        for m in [*re.finditer(r"[^\n]+?(?:[.!?](?=\s|$)|(?=\n|$))", t or ""), None]:
            key = tuple(m[0].casefold().split()) if m else None
            if m and len(key) < 4:
                continue
            first = seen.setdefault(key, (i, m.start())) if m else None
            if m and first != (i, m.start()):
                run.append((m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), len(key), first[0]))
                continue
            if sum(x[2] for x in run) >= 30:
                wanted.add((i, run[0][0], run[-1][1], sum(x[2] for x in run), len(run), run[0][3]))
            run = []
    assert {(g.doc_id, g.start, g.end, g.n_words, g.n_units, g.kept_doc_id) for g in got} == wanted and len(got) == len(wanted) > 12
    rest = {r.doc_id: r.text for r in passage_dedup.without_passages(documents(spark, rows)).collect()}
    for g in got:
        assert next(t for i, t, _ in rows if i == g.doc_id)[g.start : g.end] not in rest[g.doc_id] or g.doc_id == 92
    assert len(rest) == len({i for i, _, _ in rows}) and rest[90] is None and rest[1] == rows[1][1]


def test_runs_that_begin_inside_sentences_and_of_short_sentences(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    inner = " ".join(word() + "." * (k % 17 == 16) for k in range(50))
    short = " ".join(word() + ".!!" for _ in range(150))
    texts = {}
    for i in range(40):
        own = [word() for _ in range(r.randint(60, 120))]
        at = r.randrange(5, 50)
        texts[i] = " ".join([*own[:at], inner, *own[at:]] if i % 4 == 0 else own)
    texts |= {50: short, 51: short, 52: "x " * 200, 53: short.upper().replace(" ", "\n"), 54: "", 55: "a b c"}
    found = passage_dedup.repeated_runs(documents(spark, [(i, t, "s") for i, t in texts.items()])).collect()
    first, wanted = {}, {}  # by brute force: words of each document that lie in a run of 50 that an earlier document has
    covered = {}
    for size, marks in ((50, wanted), (4, covered)):
        first.clear()
        for i, t in texts.items():
            words = t.casefold().split()
            for k in range(len(words) - size + 1):
                if first.setdefault(tuple(words[k : k + size]), i) != i:
                    marks.setdefault(i, set()).update(range(k, k + size))
    got = {g.doc_id for g in found}
    assert set(wanted) == {4, 8, 12, 16, 20, 24, 28, 32, 36, 51, 53} and got == {*wanted, 52}
    for g in found:
        words = texts[g.doc_id][: g.start].split(), texts[g.doc_id][g.start : g.end].split()
        assert g.n_words == len(words[1]) >= 30
        if g.doc_id != 52:  # nothing but repeated words goes
            assert set(range(len(words[0]), len(words[0]) + g.n_words)) <= covered[g.doc_id]
    rest = {x.doc_id: x.text for x in passage_dedup.without_passages(documents(spark, [(i, t, "s") for i, t in texts.items()]), passage_dedup.repeated_runs).collect()}
    assert rest[50] == short and rest[51] == rest[53] == "" and 30 <= len(rest[52].split()) < 60 and rest[1] == texts[1]


@pytest.mark.parametrize(("kind", "places"), [("line", [(0, 5), (6, 11), (13, 18)]), ("paragraph", [(0, 11), (13, 18)]), ("sentence", [(0, 5), (6, 11), (13, 18)])])
def test_units_keep_offsets(kind, places):
    assert [u[1:3] for u in passage_dedup.units("a b c\nd e f\n\nG h i", kind, 3)] == places


ODD_TEXTS = ["", " ", "\n\n  a", "aaaaaaaaaaa", "<|endoftext|>", "x<|endoftext|><|endoftext|> y<|endof", "é" * 50, "a" * 3000 + "b", "՘ Ᲊ \x1c\x1f  ١٢٣", "don't WE'LL 12 34 !!  \t end "]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_vocabulary())
    r = random.Random(1)
    texts = ODD_TEXTS + ["".join(r.choice("ab aAé1!\n\t😀中t") for _ in range(r.randint(1, 80))) for _ in range(400)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(9000, None, "s")]
    got = {g.doc_id: g for g in bpe.digests(documents(spark, rows)).collect()}
    for i, t, _ in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoder = bpe.Encoder(bpe.vocabulary(bpe.default_vocabulary()), max_distinct=10)  # tables dropped again and again
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in encoder.encode([t])] == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_decode_of_stored_ids(spark):
    path = bpe.default_vocabulary()
    docs = documents(spark, [(1, "a b ü", "s"), (2, None, "s")])
    assert [r.decoded for r in bpe.decode(bpe.encode(docs, path), path).orderBy("doc_id").collect()] == ["a b ü", ""]


def test_token_counts_by_definition(spark):
    path = token_counts.default_ranks()
    score = token_counts.piece_scores(path)

    def count(word):
        best = [(0, 0)] + [None] * len(word)
        for i in range(1, len(word) + 1):
            best[i] = min((best[j][0] - score[word[j:i]], best[j][1] + 1) for j in range(max(0, i - 130), i) if word[j:i] in score)
        return best[-1][1]

    r = random.Random(1)
    texts = ODD_TEXTS[:-3] + ["".join(r.choice("the an in g. ") for _ in range(r.randint(1, 80))) for _ in range(200)]
    texts += ["".join(r.choice("thequickan") for _ in range(n)) for n in (255, 256, 257, 3000)] + ["a" * 5000, "é" * 700, "word " * 20_000]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(9000, None, "s")]
    docs = documents(spark, rows).withColumn("n_tokens", F.lit("clash")).withColumn("n_pre_tokens", F.lit(1))
    got = {g.doc_id: (g.n_tokens, g.n_pre_tokens) for g in token_counts.count_tokens(docs, path).collect()}
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0
    again = token_counts.count_tokens(documents(spark, [(None, "a b", "s"), (1, "a b", "s"), (1, "a b", "s"), (1, "c", "s")]), path).collect()
    assert sorted((g.doc_id or 0, g.n_tokens, g.n_pre_tokens) for g in again) == [(0, 2, 2), (1, 1, 1), (1, 2, 2), (1, 2, 2)]
    for i, t, _ in rows:
        words = [w.encode() for w in pretokens.pre_tokens(t or "")]
        assert got[i] == (sum(map(count, words)), len(words))


def test_token_counts_of_a_very_long_word():
    import time

    pieces = token_counts.piece_trie(token_counts.default_ranks())
    r = random.Random(1)
    word = "".join(r.choice("etaoinshrdlu") for _ in range(300_000)).encode()
    began = time.time()
    whole = token_counts.trie_counts([word, b"the"], pieces)
    assert whole[1] == 1 and 60_000 < whole[0] < 300_000 and time.time() - began < 20  # in proportion to its length


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.classify(docs.unionByName(documents(spark, [(-1, None, None), (-2, "", None), (-3, "x" * 100_000, None)])), labels).select("doc_id", "held_out", "score", "predicted").toPandas()
    assert len(got) == docs.count() + 3 and got.score.between(0, 1).all()
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    known = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (known.predicted == known.quality).mean() > 0.95 and len(known) > 50


def test_quality_without_labels(spark):
    got = quality.classify(documents(spark, [(1, "a b", "s"), (2, None, "s")]), spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in got.collect()] == [0.5, 0.5]
    assert quality.classify(documents(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_quality_odd_rows_and_bounded_training(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    few = docs.limit(3).unionByName(docs.limit(3)).unionByName(documents(spark, [(None, "a b", None), (1, "another text " * 200, "s"), (1, "w " * 200_000, "s")]))
    few = few.withColumns({"score": F.lit("clash"), "held_out": F.lit(1), "predicted": F.lit(None), "n": F.lit(2), "x": F.lit(3)})
    extra = {c: F.lit(None) for c in ("n", "x", "score", "held_out", "predicted")}
    every = few.withColumn("odd", F.lit(True)).unionByName(docs.withColumns(extra).withColumn("odd", F.lit(False)), allowMissingColumns=True)
    got = quality.classify(every, labels.withColumn("text", F.lit("clash"))).where("odd").collect()
    assert len(got) == 9 and all(0 <= g.score <= 1 for g in got) and [g.held_out for g in got if g.doc_id is None] == [False]
    assert len({g.score for g in got if g.doc_id == 1 and g.text.startswith(("another", "w "))}) == 2
    assert quality.train(docs, labels, max_passages=0) is None  # not one document fits
    small = quality.train(docs, labels, max_passages=600)
    known = quality.with_scores(docs.where(quality.held_out(F.col("doc_id"))), small).join(labels, "doc_id").toPandas()
    assert ((known.score >= 0.5) == (known.quality == 1)).mean() > 0.9


def test_quality_passes_over_what_does_not_fit_and_learns_words(spark):
    r = random.Random(8)
    text = lambda bad: " ".join(r.choice(["blue", "green", "grey", "brown", "gold", "pink"] + (["spam", "scam"] if bad else ["corn", "wool"])) for _ in range(80))
    rows = [(i, text(i % 2), "s") for i in range(400)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "doc_id long, quality int")
    docs = documents(spark, rows)
    first = quality.training_sample(labels).where("quality = 0").orderBy(F.xxhash64("doc_id")).first().doc_id
    docs = docs.withColumn("text", F.when(F.col("doc_id") == first, F.lit("word " * 64_000)).otherwise(F.col("text")))
    got = quality.with_scores(docs.where(quality.held_out(F.col("doc_id"))), quality.train(docs, labels, max_passages=900)).toPandas()
    assert len(got) > 50 and ((got.score >= 0.5) == (got.doc_id % 2 == 0)).mean() > 0.95


def test_passages_and_pieces_of_odd_tables(spark):
    empty = documents(spark, [])
    clash = {"start": F.lit("clash"), "place": F.lit(1), "first": F.lit(None), "n_tokens": F.lit("clash"), "ids": F.lit(2)}
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = documents(spark, [(1, long, "s"), (2, long, "s"), (2, long, "s"), (None, long, "s"), (3, "ab" * 60_000, "s"), (4, None, None)]).withColumns(clash)
    got = sorted((g.doc_id, g.start, g.end, g.n_words, g.kept_doc_id) for g in passage_dedup.repeated_runs(docs).collect())
    assert got == [(2, 0, len(long), 60_000, 1)]
    assert passage_dedup.repeated_runs(empty).count() == passage_dedup.repeated_passages(empty).count() == bpe.digests(empty).count() == 0
    found = bpe.digests(docs).collect()
    assert len(found) == 6 and len({g.ids_sha256 for g in found}) == 3 and all(g.n_tokens > 0 for g in found if g.doc_id != 4)


def test_attention_gradients():
    r = np.random.default_rng(0)
    x, owner, y = r.normal(size=(9, 3)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    w = {"W": r.normal(size=(3, 4)), "b": r.normal(size=4), "V": r.normal(size=(4, 2)), "U": r.normal(size=(4, 2)), "a": r.normal(size=2), "c": r.normal(size=4), "d": r.normal(size=1)}
    loss = lambda w: -np.mean(y * np.log(p := quality._forward(w, x, owner, 3)["p"]) + (1 - y) * np.log(1 - p))
    for name, g in quality._gradients(w, x, owner, y, 0.0).items():
        for at in np.ndindex(g.shape):
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - g[at]) < 1e-6


def article_by_tags(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    if not inner:
        return ""
    text = re.sub(r"<[^>]*\Z", "", inner[1])
    blocks = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\0", text))).split("\0")
    return "\n".join(b for b in (" ".join(htmllib.unescape(x).split()) for x in blocks) if b)


def test_main_text_of_given_pages(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id] == (article_by_tags(p.html), len(article_by_tags(p.html)))


LONG = "A sentence of the article that is long enough to be one, and says what there is to say about it."
THREAD = "".join(f'<div class="m"><em>{who}</em><p>{what}</p></div>' for who, what in [("Ida", "I liked it."), ("Jon", "Me too, and I will read it again."), ("Kim", "No, thanks.")])
LAYOUTS = {
    "null": (None, ""), "empty": ("", ""), "plain": ("plain words only, without any markup at all", "plain words only, without any markup at all"), "cut": ("<p>cut <b", "cut"),
    "known parts": (
        '<html><body><div class="navbar"><a href="/">x</a></div><article><h1>T &amp; U</h1><p>One  two\n three, which is a sentence.<br>four</p><div class="cookie-notice">We use cookies, you know.</div><p>Last paragraph &lt;here&gt;, with words in it.</p></article><div class="comments"><p>A reader says that this is a fine text.</p></div><aside>More to read, over there.</aside><script>var a = "<p>no</p>"</script></body></html>',
        "T & U\nOne two three, which is a sentence. four\nLast paragraph <here>, with words in it.",
    ),
    "deep": ("<div>" * 3000 + "deep text that goes on for a while, as it should" + "</div>" * 3000, "deep text that goes on for a while, as it should"),
    "less deep": ("<div>" * 300 + "A sentence." + "</div>" * 300, "A sentence."),
    "bare body": (f"<html><body><p>{LONG}</p><p>Short one.</p></body></html>", f"{LONG}\nShort one."),
    "bare paragraphs": (f"<p>{LONG}<p>{LONG}", f"{LONG}\n{LONG}"),
    "no landmarks": (f'<body><div><a href="/">Home</a> <a href="/a">About</a></div><div><h1>Name of it</h1><p>{LONG}</p><p>{LONG}</p></div></body>', f"Name of it\n{LONG}\n{LONG}"),
    "thread after the article": (f'<body><article><h1>N</h1><p>{LONG}</p></article><div id="thread">{THREAD}</div></body>', f"N\n{LONG}"),
    "thread in the article": (f'<body><article><h1>N</h1><p>{LONG}</p><p>{LONG}</p><div id="thread">{THREAD}</div></article></body>', f"N\n{LONG}\n{LONG}"),
    "thread without landmarks": (f'<body><div id="a"><h1>N</h1><p>{LONG}</p><p>{LONG}</p></div><div id="thread">{THREAD}</div></body>', f"N\n{LONG}\n{LONG}"),
    "formula": (f"<body><article><p>{LONG} It is <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here.</p><object data='f'><p>{LONG}</p></object></article></body>", f"{LONG} It is x=1 here.\n{LONG}"),
    "parts": (f'<body><main><section class="s"><h2>One</h2><p>{LONG}</p><p>{LONG}</p></section><section class="s"><h2>Two</h2><p>{LONG}</p><p>{LONG}</p></section></main></body>', "\n".join(["One", LONG, LONG, "Two", LONG, LONG])),
    "inner notices": (f'<body><div class="topbar"><a href="/">x</a></div><article><h1>N</h1><p>{LONG}</p><div class="newsletter-signup"><p>Letters from us, every week.</p></div><p>Short.</p><section class="related-posts"><h3>More</h3><ul><li><a href="/o">Other</a></li></ul></section></article></body>', f"N\n{LONG}\nShort."),
    "classed list": (f'<body><article><h1>N</h1><p>{LONG}</p><ul><li class="item">One point that is short.</li><li class="item">Another point.</li></ul><p>{LONG}</p></article></body>', f"N\n{LONG}\nOne point that is short.\nAnother point.\n{LONG}"),
    "classed list at the end": (f'<body><article><h1>N</h1><p>{LONG}</p><ul><li class="item"><b>One</b> is short.</li><li class="item"><b>Two</b> too.</li></ul></article></body>', f"N\n{LONG}\nOne is short.\nTwo too."),
    "classed quotes": (f'<body><article><p>{LONG}</p><blockquote class="q">It rains.</blockquote><blockquote class="q">It does not.</blockquote><p>{LONG}</p></article></body>', f"{LONG}\nIt rains.\nIt does not.\n{LONG}"),
    "classed rows": (f'<body><article><p>{LONG}</p><table><tr class="r"><td>1</td><td>2</td></tr><tr class="r"><td>3</td><td>4</td></tr></table><p>{LONG}</p></article></body>', f"{LONG}\n1 2\n3 4\n{LONG}"),
    "steps": ('<body><article><section class="step"><h2>Step 1</h2><p>Mix the flour.</p></section><section class="step"><h2>Step 2</h2><p>Bake the bread.</p></section></article></body>', "Step 1\nMix the flour.\nStep 2\nBake the bread."),
    "steps in a page with a menu": (f'<body><nav><a href="/">x</a></nav><article><h1>N</h1><p>{LONG}</p><div class="step"><h3>One</h3><p>Mix it.</p></div><div class="step"><h3>Two</h3><p>Bake it.</p></div></article></body>', f"N\n{LONG}\nOne\nMix it.\nTwo\nBake it."),
    "one item and a short quote": (f'<body><nav><a href="/">x</a></nav><article><p>{LONG}</p><ul><li>One.</li></ul><blockquote><p>Yes.</p></blockquote><p>{LONG}</p></article></body>', f"{LONG}\nOne.\nYes.\n{LONG}"),
    "links in the text": (f'<body><nav><a href="/">x</a></nav><article><p><a href="/l">{LONG}</a></p><p>{LONG}</p><ol><li><a href="/m">Here</a></li><li><a href="/n">There</a></li></ol><figure><img src="i"><figcaption>Seen from above</figcaption></figure></article></body>', f"{LONG}\n{LONG}\nHere\nThere\nSeen from above"),
    "right column": (f'<body><div id="a"><h1>N</h1><p>{LONG}</p><p>{LONG}</p></div><div class="right"><h3>More</h3><p>Some other things to see here.</p></div></body>', f"N\n{LONG}\n{LONG}"),
    "long comments": (f'<body><article><h1>N</h1><p>{LONG}</p><p>{LONG}</p><div>' + "".join(f'<div class="m"><b>{who}</b><p>{LONG} {LONG}</p></div>' for who in ("Ida", "Jon")) + "</div></article></body>", f"N\n{LONG}\n{LONG}"),
    "form and advert": (f'<body><nav><ul><li><a href="/">a</a></li></ul></nav><article><p>{LONG}</p><form><label>Mail</label><input value="no"></form><div class="advert">Buy this, it is cheap.</div><p>{LONG}</p></article><footer>End</footer></body>', f"{LONG}\n{LONG}"),
}


@pytest.fixture(scope="module")
def layouts(spark):
    given = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = [(i, "u", html) for i, (html, _) in enumerate(LAYOUTS.values())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = html_extract.extract(pages, html_extract.train(given))
    return {r.page_id: r for r in found.collect()}


@pytest.mark.parametrize("name", LAYOUTS)
def test_main_text_of_other_layouts(layouts, name):
    got = layouts[list(LAYOUTS).index(name)]
    assert got.text == LAYOUTS[name][1] and got.n_chars == len(got.text) and got.url == "u"


def test_main_text_of_no_pages_and_of_repeated_ones(spark):
    pages = spark.createDataFrame([(1, None, "<p>a b"), (1, None, "<p>a b"), (None, "v", "<p>a b")], "page_id long, url string, html string")
    assert [r.text for r in html_extract.extract(pages).collect()] == ["a b"] * 3
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_sum_product_gives_exact_marginals():
    import itertools
    import math

    model = html_extract.TreeModel()
    model.weight, model.pair = {"a": 0.7, "b": -1.1, "c": 0.2}, [[0.3, -0.6], [-0.2, 0.9]]
    feats, parent = [("a",), ("b",), ("a", "c"), ("c",), ("b",)], [-1, 0, 0, 1, 1]
    total, on = 0.0, [0.0] * 5
    for y in itertools.product((0, 1), repeat=5):
        e = math.exp(sum(model.weight[x] for f, v in zip(feats, y) if v for x in f) + sum(model.pair[y[parent[k]]][y[k]] for k in range(1, 5)))
        total += e
        on = [o + e * v for o, v in zip(on, y)]
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(model.marginals(feats, parent), on))
