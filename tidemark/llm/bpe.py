"""Byte-level BPE encoding and decoding through a pair occurrence index.

A task numbers the distinct pre-tokens of its texts, lays all their bytes out in one array, and maps every adjacent
pair that has a merge rank to the list of its positions.  Active ranks are applied in ascending order, each to all of
its positions at once; every merge removes the two pairs beside it and files the new ones under their own ranks.
Texts are then put together from the numbers of their pre-tokens.  Nothing is shuffled: documents stay in the
partition they were read in, and a task's tables are dropped whenever they outgrow ``max_distinct`` pre-tokens.

Defined cases: null and empty texts have no ids; the special token's string in a text is the special token; ids are
little-endian unsigned 32-bit integers in a binary column; decoding replaces bytes that are not UTF-8; texts of any
length are encoded whole, also one long word; rows that repeat are encoded each; a null doc_id is passed on; an empty
table gives an empty result.  Other columns, whatever their names, are passed on, but for the output column, which is
replaced.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.pretokens import SPECIAL, Interner, gather, pre_tokens_with_special
from tidemark.llm.shared import lean, table, text_chunks

NONE = np.int32(1 << 30)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Vocabulary files write bytes as printable letters: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        letters = _byte_letters()
        ids = stored["model"]["vocab"]
        special = {x["content"]: x["id"] for x in stored["added_tokens"]}
        self.special = special.get(SPECIAL)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in stored["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        self.same = left == right
        keys = left << 20 | right
        self.rank_of = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank_of]
        self.byte_id = np.zeros(256, dtype=np.int32)
        for letter, byte in letters.items():
            self.byte_id[byte] = ids[letter]
        size = max(max(ids.values()), *special.values()) + 1
        words = [b""] * size
        for word, i in ids.items():
            words[i] = bytes(letters[c] for c in word)
        for word, i in special.items():
            words[i] = word.encode()
        self.bytes = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank_of[at], NONE)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_words(words: list[bytes], voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and how many each has."""
    # every word is followed by a -1, which has no pair; so has the front
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    length = np.array([len(w) for w in words], dtype=np.int64)
    word = np.repeat(np.arange(len(words), dtype=np.int32), length)
    at = np.arange(1, len(raw) + 1, dtype=np.int32) + word
    n = len(raw) + len(words) + 1
    sym = np.full(n, -1, dtype=np.int32)
    sym[at] = voc.byte_id[raw]
    follow = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    rank = np.full(n, NONE, dtype=np.int32)
    rank[:-1] = voc.ranks(sym[:-1], sym[1:])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def file(positions: np.ndarray) -> None:
        own = rank[positions]
        positions = positions[own < NONE]
        if not len(positions):
            return
        own = rank[positions]
        order = np.argsort(own, kind="stable")
        positions, own = positions[order], own[order]
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        firsts = own[np.concatenate([[0], cuts])].tolist()
        for r, group in zip(firsts, np.split(positions, cuts) if len(cuts) else [positions]):
            if r in index:
                index[r].append(group)
            else:
                index[r] = [group]
                heapq.heappush(heap, r)

    file(np.flatnonzero(rank < NONE).astype(np.int32))
    while heap:
        r = heapq.heappop(heap)
        p = np.unique(np.concatenate(index.pop(r)))
        p = p[rank[p] == r]
        if not len(p):
            continue
        if voc.same[r]:  # of overlapping pairs of one symbol, every other one from the left
            chained = np.concatenate([[False], follow[p[:-1]] == p[1:]])
            start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(p))))
            p = p[(np.arange(len(p)) - start) % 2 == 0]
        q = follow[p]
        sym[p] = voc.merged[r]
        sym[q] = -2
        rank[q] = NONE
        after = follow[q]
        follow[p] = after
        before[after] = p
        left = before[p]
        touched = np.concatenate([p, left])
        rank[touched] = voc.ranks(sym[touched], sym[follow[touched]])
        file(touched)
    live = sym >= 0
    inside = np.zeros(n, dtype=np.int32)
    inside[at] = word
    return sym[live], np.bincount(inside[live], minlength=len(words))


class Encoder:
    """Encodes texts; remembers the pre-tokens it has met."""

    def __init__(self, voc: Vocabulary, max_distinct: int = 150_000) -> None:
        self.voc, self.max_distinct = voc, max_distinct
        self.clear()

    def clear(self) -> None:
        self.seen = Interner()
        self.flat, self.offsets = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.seen) > self.max_distinct:
            self.clear()
        known = len(self.seen)
        numbers = [np.array(self.seen.number(pre_tokens_with_special(text)), dtype=np.int32) for text in texts]
        ends = np.cumsum([len(x) for x in numbers])
        new = self.seen.since(known)
        if new:
            ids, counts = encode_words([b"" if w == SPECIAL else w.encode() for w in new], self.voc)
            if SPECIAL in self.seen.ids and (k := self.seen.ids[SPECIAL] - known) >= 0:
                ids, counts = np.insert(ids, counts[:k].sum(), self.voc.special), counts + (np.arange(len(counts)) == k)
            self.flat = np.concatenate([self.flat, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
        all_ids, word_ends = gather(self.flat, self.offsets, np.concatenate(numbers)) if len(numbers) else (self.flat[:0], [])
        all_ids, word_ends = all_ids.astype("<u4"), np.concatenate([[0], word_ends])
        cuts = word_ends[np.concatenate([[0], ends]).astype(np.int64)].astype(np.int64)
        return [all_ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), values], names=[*(batch.schema.names[i] for i in keep), name])


def decode_ids(value: bytes, voc: Vocabulary) -> str:
    raw, _ = gather(voc.bytes, voc.offsets, np.frombuffer(value, dtype="<u4").astype(np.int64))
    return raw.tobytes().decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` in the binary column ``out``, and what they decode to in ``decoded`` if named.

    To decode in the same pass saves a second set of Python workers and the way of the ids there.
    """
    fresh = [T.StructField(out, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    schema = T.StructType([*(f for f in docs.schema if f.name not in (out, decoded)), *fresh])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        encoder = Encoder(voc)
        for batch in text_chunks(batches, 6 << 20):
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            batch = _with_column(batch, out, pa.array(ids, pa.binary()))
            if decoded:
                batch = _with_column(batch, decoded, pa.array((decode_ids(x, voc) for x in ids), pa.string()))
            yield batch

    return docs.mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of the token ids in the string column ``out``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else decode_ids(x, voc) for x in batch.column(ids).to_pylist()]
            yield _with_column(batch, out, pa.array(texts, pa.string()))

    schema = T.StructType([*(f for f in encoded.schema if f.name != out), T.StructField(out, T.StringType())])
    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    both = encode(docs.select("doc_id", "text"), path or default_vocabulary(), decoded="decoded")
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
