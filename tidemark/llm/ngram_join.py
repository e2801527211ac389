"""Exact Jaccard self-join on word shingles with a token-group matrix.

A document is the set of its distinct ``k``-word shingles; two link when their Jaccard similarity is at least
``percent`` / 100.  Texts with equal sets are collapsed first.  Similar documents are then partitioned into groups, the
token-group matrix says which tokens each group holds, a document asks only groups that can hold a partner, the overlap
of document and group union bounds every member's overlap, and only groups that pass the bound are opened.  Every bound
is a necessary condition, so no link between different texts is lost, however the groups are drawn.

1. Tokens are ordered by how often they repeat, rare ones first, ties by hash.  Repeats are counted over all documents
   in windows of ``WINDOW`` tokens; the order decides cost only, never results.
2. Of sets that link, the first n - ceil(percent * n / 100) + l tokens of each have l in common at least, for l up to the
   overlap that a link needs; here l is ``SLACK`` percent of n.  These prefix postings are shuffled by token, and
   tokens that repeat often in slices, so none fills a task; tokens of one set only go, and so do documents with fewer shared prefix tokens than any link of theirs needs.  Just the
   documents that are left are read again, and have their whole sets made.
3. Groups: rounds of min-hash bring similar sets together in chunks of ``CHUNK``; sets of a chunk that are alike by
   ``ALIKE`` percent become one group, and only its best connected member goes on to the next round.  A cluster of near
   copies with a third of all rows thus shrinks by the size of a chunk in every round.
4. Token-group matrix: (token, group) pairs of the tokens that more than one group holds, joined group to group.  Of two
   groups that share enough tokens and have a fitting range of set sizes, members of the smaller ask the larger.
5. Groups are cut into blocks of ``CHUNK`` members, their askers into blocks too.  In a task, the overlap of an asker with
   the union of a block bounds its overlap with every member; only blocks that pass are opened.  Members of one group
   ask each other in the same way, block by block.  A task returns one link per document at most.
6. Links are contracted to components.

Defined cases: an empty table gives an empty result; texts of any length give all their shingles; columns besides doc_id and
text are ignored; A-Z count as a-z; fewer than k words are one shingle; null, empty and blank texts have none, and link
with nothing; equal texts are one component; rows that repeat a doc_id are one document, and are taken to have one text;
rows without doc_id are components of their own (null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.hashing import digest, scramble, shingle_sets
from tidemark.llm.shared import lean, map_groups, partitions, skew_join, stored, table, text_chunks

WINDOW, REPEATED, MAX_ORDERED = 2_000_000, 3, 200_000
CHUNK, ROUNDS, SLACK, ALIKE = 96, 4, 3, 50
TEXTS = 1 << 20  # bytes of text hashed at once; their arrays take some 30 times that
SLICE = 1024  # postings of one token, as far as its repeats are known, that are dealt together
FILTER_BITS, BITMAP_BITS = 1 << 25, 32_768


def at_least(n: int, percent: int) -> int:
    """The smallest set, and overlap, that a set of n tokens can link with."""
    return -(-n * percent // 100)


def common_prefix(n: int) -> int:
    """How many prefix tokens linked sets of n tokens and more have in common at least."""
    return max(1, n * SLACK // 100)


def needed(n: Column, percent: int) -> Column:
    """How many prefix tokens a set of n tokens shares with any linked set: as many as the smallest partner must."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * percent / 100) * SLACK / 100))


def repeated_tokens(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that repeat within windows, sorted, and their counts; the ``MAX_ORDERED`` most frequent at most.

    A token of d distinct sets in w windows is found for certain where d > (REPEATED - 1) * w.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: dict[bytes, np.ndarray] = {}
        held = 0

        def counted() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate([*window.values(), np.zeros(0, np.uint64)]), return_counts=True)
            often = count >= REPEATED
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names=["token", "n"])

        for batch in text_chunks(batches, TEXTS):
            for tokens in shingle_sets([t or "" for t in batch.column("text").to_pylist()], k):
                if len(tokens):
                    window[digest(tokens)] = tokens  # equal sets count once
                    held += len(tokens)
            if held >= WINDOW:
                yield counted()
                window.clear()
                held = 0
        yield counted()

    counts = stored(docs.select("text").mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "repeats")
    by_size = counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("size")).count().orderBy(F.desc("size")).collect()  # a few hundred rows
    total, least = 0, None
    for r in by_size:
        total += r["count"]
        if total > MAX_ORDERED:
            break
        least = r["size"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.where(F.floor(F.log2("n") * 4) >= least).toPandas().sort_values("token")
    token, n = rows.token.to_numpy(np.int64).view(np.uint64), rows.n.to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], n[order]


def prefix(tokens: np.ndarray, percent: int, often: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens in the common order: linked sets share ``common_prefix`` of them; and how often each repeats (0: rarely)."""
    n = len(tokens)
    size = n - at_least(n, percent) + common_prefix(n)
    if len(often):
        at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
        weight = np.where(often[at] == tokens, counts[at], 0)
        if weight.any():
            order = np.lexsort((tokens, weight))[:size]
            return tokens[order], weight[order]
    return tokens[:size], np.zeros(min(n, size), np.int64)


def min_hashes(tokens: np.ndarray) -> list[int]:
    return [int(scramble(tokens + np.uint64(1 + r)).min().view(np.int64)) for r in range(ROUNDS)]


def _sketches(docs: DataFrame, k: int, percent: int, often: np.ndarray, counts: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, TEXTS):
            sets = shingle_sets([t or "" for t in batch.column("text").to_pylist()], k)
            signature = [digest(s) if len(s) else None for s in sets]
            first = [prefix(s, percent, often, counts) if len(s) else (s, np.zeros(0, np.int64)) for s in sets]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f, _ in first])]).astype(np.int32))
            flat = lambda parts, dtype: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*parts, np.zeros(0, dtype)])))
            lists = [flat([f.view(np.int64) for f, _ in first], np.int64), flat([(w // SLICE + 1).astype(np.int32) for _, w in first], np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(signature, pa.binary()), *lists], names=["doc_id", "n", "signature", "prefix", "slices"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, signature binary, prefix array<long>, slices array<int>")


def _postings(heads: DataFrame, n_parts: int) -> DataFrame:
    """``(token, rep, n)``: prefix tokens of the sets ``(doc_id, n, prefix, slices)``, without those that one set alone holds.

    One shuffle, by token and slice: a token that repeats often is cut into slices of about ``SLICE`` rows, so no task has
    all sets of one.  Tokens in slices are kept unasked; to keep too many is only a cost.
    """
    marks = heads.select(F.col("doc_id").alias("rep"), F.col("n").cast("int").alias("n"), F.explode(F.arrays_zip("prefix", "slices")).alias("at"))
    slice = F.when(F.col("at.slices") > 1, F.pmod(F.xxhash64("rep"), F.col("at.slices")).cast("int") + 1).otherwise(0)  # 0: not cut
    marks = marks.select(F.col("at.prefix").alias("token"), slice.alias("slice"), "rep", "n").repartition(n_parts, "token", "slice")
    shared = marks.groupBy("token", "slice").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("slice > 0 OR lo < hi").select("token", "slice")
    return marks.join(shared, ["token", "slice"]).select("token", "rep", "n")


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids``, and a few others that share its place in a bitmap.

    The bitmap has ``FILTER_BITS`` bits whatever the number of ids (4 MB at most, so it can be broadcast), and texts need
    no shuffle.  With very many ids it lets more rows through, which costs time and nothing else.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    part, bit = F.floor(place / BITMAP_BITS), place % BITMAP_BITS
    maps = ids.groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(bit).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.expr("shiftright(_byte, cast(_bit % 8 as int))").bitwiseAND(F.lit(1)) == 1
    marked = docs.where(F.col("doc_id").isNotNull()).withColumns({"_part": part, "_bit": bit}).join(F.broadcast(maps), "_part")
    return marked.withColumn("_byte", byte).where(on).select(*docs.columns)


def _whole_sets(docs: DataFrame, k: int) -> DataFrame:
    names = ["rep", "n", *(f"m{r}" for r in range(ROUNDS)), "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, TEXTS):
            sets = shingle_sets([t or "" for t in batch.column("text").to_pylist()], k)
            hashes = np.array([min_hashes(s) if len(s) else [0] * ROUNDS for s in sets], dtype=np.int64).reshape(-1, ROUNDS)
            cols = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(hashes[:, r]) for r in range(ROUNDS)), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(lean(run), "rep long, n long, " + "".join(f"m{r} long, " for r in range(ROUNDS)) + "tokens binary")


class Members:
    """The sets of one group: all tokens with their owners, so one look-up compares a set with every member."""

    def __init__(self, tokens: list[bytes]) -> None:
        sets = [np.frombuffer(t, dtype=np.uint64) for t in tokens]
        self.sets = sets
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], self.owner[order]
        fresh = np.concatenate([[True], self.flat[1:] != self.flat[:-1]]) if len(flat) else np.zeros(0, bool)
        self.union, self.start = self.flat[fresh], np.concatenate([np.flatnonzero(fresh), [len(flat)]])

    def overlaps(self, tokens: np.ndarray) -> tuple[int, np.ndarray]:
        """Overlap with the union, and the places in the union that are met."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        met = at[self.union[at] == tokens]
        return len(met), met

    def links(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """Which members link with the set; nobody is opened if the union's overlap is too small."""
        none = np.zeros(len(self.sets), dtype=bool)
        if not len(self.union):
            return none
        bound, met = self.overlaps(tokens)
        if 100 * bound < percent * len(tokens):
            return none
        width = self.start[met + 1] - self.start[met]
        where = np.repeat(self.start[met] - np.cumsum(width) + width, width) + np.arange(width.sum())
        common = np.bincount(self.owner[where], minlength=len(self.sets))
        return 100 * common >= percent * (self.size + len(tokens) - common)


def chunk_groups(reps: list[int], tokens: list[bytes], percent: int) -> list[list[int]]:
    """Members of a chunk by what they reach by links inside it; each list begins with the member that has most links."""
    members = Members(tokens)
    linked = np.stack([members.links(s, percent) for s in members.sets])
    degree, left, out = linked.sum(1), np.ones(len(reps), dtype=bool), []
    for seed in np.lexsort((reps, -degree)).tolist():
        if not left[seed]:
            continue
        found = np.zeros(len(reps), dtype=bool)
        edge = found.copy()
        edge[seed] = True
        while edge.any():
            found |= edge
            edge = linked[edge].any(0) & ~found
        left &= ~found
        out.append([seed, *(i for i in np.flatnonzero(found).tolist() if i != seed)])
    return out


def _grouping(sets: DataFrame) -> DataFrame:
    """``(rep, grp)``: groups of similar sets after all rounds of min-hash; a group is named after one of its members."""
    label = sets.select("rep", F.col("rep").alias("grp")).distinct()
    heads = sets.drop("tokens")

    def work(group: pa.Table) -> dict[str, list] | None:
        if len(group) < 2:
            return None
        reps = group.column("rep").to_pylist()
        moved = [(reps[i], reps[own[0]]) for own in chunk_groups(reps, group.column("tokens").to_pylist(), ALIKE) for i in own[1:] if reps[i] != reps[own[0]]]
        return {"rep": pa.array([a for a, _ in moved], pa.int64()), "head": pa.array([b for _, b in moved], pa.int64())} if moved else None

    for r in range(ROUNDS):
        keyed = heads.select(F.col(f"m{r}").alias("m"), "rep")
        size = keyed.groupBy("m").count().where("count > 1").select("m", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
        dealt = skew_join(keyed, size, "m").select("m", "rep", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"))
        moved = stored(map_groups(dealt.join(sets.select("rep", "tokens"), "rep"), ["m", "chunk"], work, "rep long, head long").groupBy("rep").agg(F.min("head").alias("head")), "moved")
        label = skew_join(label, moved.withColumnRenamed("rep", "grp"), "grp", "left").select("rep", F.coalesce("head", "grp").alias("grp"))
        label = stored(label, "groups")
        heads = heads.join(moved.select("rep"), "rep", "left_anti")
    return label


def block_links(asking: list[bool], asked: list[bool], reps: list[int], tokens: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links between askers and members as a forest: each linked document with the first one of its part."""
    here = [i for i, a in enumerate(asked) if a]
    if not here:
        return []
    members, pairs = Members([tokens[i] for i in here]), []
    for q, (asks, t) in enumerate(zip(asking, tokens)):
        if asks:
            pairs += [(q, here[k]) for k in np.flatnonzero(members.links(np.frombuffer(t, dtype=np.uint64), percent)).tolist()]
    if not pairs:
        return []
    i, j = np.array(pairs).T
    root = np.arange(len(reps))
    while True:
        low, new = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return [(reps[k], reps[root[k]]) for k in np.flatnonzero(root != np.arange(len(reps))).tolist() if reps[k] != reps[root[k]]]


def _links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` from rows ``(grp, x, y, rep, asks, asked)``: who asks whom in each pair of blocks."""

    def work(group: pa.Table) -> dict[str, list] | None:
        columns = [group.column(c).to_pylist() for c in ("asks", "asked", "rep", "tokens")]
        found = block_links(*columns, percent)
        return {"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())} if found else None

    whole = skew_join(placed, sets.select("rep", "tokens"), "rep")
    return stored(map_groups(whole.select("grp", "x", "y", "rep", "asks", "asked", "tokens"), ["grp", "x", "y"], work, "a long, b long"), "links")


def _blocks(label: DataFrame) -> DataFrame:
    """``(rep, grp, size, block, n_blocks)``."""
    size = label.groupBy("grp").agg(F.count("*").alias("size")).withColumn("n_blocks", F.ceil(F.col("size") / CHUNK).cast("int"))
    return skew_join(label, size, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))


def _links_inside(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one group, block by block: block y asks block x for all x up to y."""
    many = blocks.where("size > 1")
    asks = F.transform(F.sequence(F.lit(0), F.col("block")), lambda x: F.struct(x.alias("x"), F.col("block").alias("y"), F.lit(True).alias("asks"), (x == F.col("block")).alias("asked")))
    later = F.filter(F.sequence(F.col("block"), F.col("n_blocks") - 1), lambda y: y > F.col("block"))
    asked = F.transform(later, lambda y: F.struct(F.col("block").alias("x"), y.alias("y"), F.lit(False).alias("asks"), F.lit(True).alias("asked")))
    return _links(many.select("grp", "rep", F.explode(F.concat(asks, asked)).alias("at")).select("grp", "at.*", "rep"), sets, percent)


def _links_across(postings: DataFrame, blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of different groups, found through the token-group matrix."""
    held = postings.join(blocks.select("rep", "grp", "size"), "rep").groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("size").alias("size"))
    held = stored(held, "matrix")
    shared = held.groupBy("token").agg(F.min("grp").alias("first"), F.max("grp").alias("last")).where("first < last").select("token")
    held = stored(skew_join(held, shared, "token"), "matrix")
    other = held.select("token", F.col("grp").alias("o"), F.col("low").alias("o_low"), F.col("high").alias("o_high"), F.col("size").alias("o_size"))
    fits = (F.col("low") * percent <= F.col("o_high") * 100) & (F.col("o_low") * percent <= F.col("high") * 100)
    smaller = F.struct("size", "grp") < F.struct(F.col("o_size"), F.col("o"))
    met = skew_join(held, other, "token").where(smaller & fits).groupBy("grp", "o").agg(F.count("*").alias("met"), F.min("low").alias("low"))
    asks = stored(met.where(F.col("met") >= needed(F.col("low"), percent)).select("grp", "o"), "asks")
    asking = skew_join(blocks.select("rep", "grp"), asks, "grp").select("rep", F.col("o").alias("grp"))
    size = asking.groupBy("grp").agg(F.ceil(F.count("*") / (4 * CHUNK)).cast("int").alias("n_asking"))
    askers = skew_join(asking, blocks.groupBy("grp").agg(F.max("n_blocks").alias("n_blocks")).join(size, "grp"), "grp")
    askers = askers.withColumn("y", F.pmod(F.xxhash64("rep"), F.col("n_asking")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    members = skew_join(blocks, size, "grp").withColumn("x", F.col("block")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n_asking") - 1)))
    role = lambda df, asks: df.select("grp", "x", "y", "rep", F.lit(asks).alias("asks"), F.lit(not asks).alias("asked"))
    return _links(role(askers, True).unionByName(role(members, False)), sets, percent)


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``."""
    n_parts = partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    often, counts = repeated_tokens(docs, k)
    sketch = stored(_sketches(docs, k, percent, often, counts), "sketches")
    reps = sketch.where("signature IS NOT NULL AND doc_id IS NOT NULL").groupBy("signature").agg(F.min("doc_id").alias("rep"))
    heads = sketch.select("doc_id", "n", "prefix", "slices").join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    postings = stored(_postings(heads, n_parts), "postings")
    asked = postings.groupBy(F.col("rep").alias("doc_id")).agg(F.count("*").alias("shared"), F.min("n").alias("n")).where(F.col("shared") >= needed(F.col("n"), percent)).select("doc_id")
    sets = stored(_whole_sets(among(docs, asked), k), "sets")
    blocks = stored(_blocks(_grouping(sets)), "blocks")
    links = _links_inside(blocks, sets, percent).unionByName(_links_across(postings, blocks, sets, percent))
    label = connected_components(links).withColumnRenamed("node", "rep")
    heads = reps.join(label, "rep", "left").select("signature", F.coalesce("component", "rep").alias("component"))
    out = skew_join(sketch.select("doc_id", "n", "signature"), heads, "signature", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
