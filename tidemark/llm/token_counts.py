"""Token counts under a unigram model, by dynamic programming on a trie of pre-tokens.

A task inserts the distinct pre-tokens of its texts in a trie of bytes.  For every trie node, that is for every
distinct prefix, the best forward score of a segmentation into vocabulary pieces is computed once, level by level:
``best[v] = max over pieces that end at v of best[ancestor] + score(piece)``, with the number of pieces along the best
path carried beside it.  Terminal nodes give the pre-token its count, and a document's count is the sum over its
pre-tokens.  Nothing is shuffled.

A level is one pass over all nodes of a depth, which pays where many words are that long.  Beyond ``LEVELS`` bytes words
share no prefixes worth a pass each: there the same recursion runs along one word at a time, over the vocabulary's trie.
It starts from the word's first byte, so it needs nothing of the levels before.

Scores are Zipf weights of a public rank file: a piece of rank r has log-probability -log(r + 1) up to a constant per
piece, in whole micro-nats, so sums are exact and equal in any order.  Of equal scores the segmentation with fewer
pieces counts.  All 256 single bytes are pieces, so every text has a segmentation.

Defined cases: null and empty texts have no tokens; texts of any length are counted whole, also one long word without
blanks; rows that repeat, with one doc_id or several, are counted row by row; a null doc_id is passed on; an empty table
gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.pretokens import Interner, pre_tokens
from tidemark.llm.shared import table, text_chunks

LOWEST = -(1 << 60)
LEVELS = 256


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_scores(path: str) -> dict[bytes, int]:
    """Whole micro-nats for each piece: the normalised Zipf log-probability of its rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    norm = np.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -int(round(1e6 * (np.log(r + 1) + norm))) for piece, r in ranks.items()}


class PieceTrie:
    """The vocabulary as a trie in arrays: state * 256 + byte, sorted, gives the next state; ``score`` of a state that ends a piece."""

    def __init__(self, scores: dict[bytes, int]) -> None:
        pieces = sorted(scores)
        step: dict[int, int] = {}
        score = [LOWEST]
        for piece in pieces:
            state = 0
            for byte in piece:
                key = state << 8 | byte
                if key not in step:
                    step[key] = len(score)
                    score.append(LOWEST)
                state = step[key]
            score[state] = scores[piece]
        self.keys = np.array(sorted(step), dtype=np.int64)
        self.next = np.array([step[k] for k in self.keys.tolist()], dtype=np.int64)
        self.score = np.array(score, dtype=np.int64)
        self.longest = max(map(len, pieces))
        self.scores = scores
        self._steps: list[dict[int, tuple[int, int]]] | None = None

    def steps(self) -> list[dict[int, tuple[int, int]]]:
        """Per state the next state and its score for each byte, for walks along one word."""
        if self._steps is None:
            out: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(self.score))]
            for key, to in zip(self.keys.tolist(), self.next.tolist()):
                out[key >> 8][key & 255] = (to, int(self.score[to]))
            self._steps = out
        return self._steps

    def advance(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        key = state << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (state >= 0), self.next[at], -1)


@functools.cache
def piece_trie(path: str) -> PieceTrie:
    return PieceTrie(piece_scores(path))


def word_count(word: bytes, pieces: PieceTrie) -> int:
    """Number of pieces in the best segmentation of one long word; what is held are the places a piece can still reach."""
    steps, n, width = pieces.steps(), len(word), pieces.longest + 1
    worst = (LOWEST, 0)
    best = [worst] * width  # a ring: best score and, of equal ones, the fewest pieces (as a negative number)
    best[0] = (0, 0)
    for start in range(n):
        at = start % width
        score, used = best[at]
        best[at] = worst
        state, place = 0, start
        while place < n:
            step = steps[state].get(word[place])
            if step is None:
                break
            state, gain = step
            place += 1
            if gain > LOWEST:
                found = (score + gain, used - 1)
                slot = place % width
                if found > best[slot]:
                    best[slot] = found
    return -best[n % width][1]


def trie_counts(words: list[bytes], pieces: PieceTrie) -> np.ndarray:
    """Number of pieces in the best segmentation of each word."""
    long = [i for i, w in enumerate(words) if len(w) > LEVELS]
    if long:
        counts = np.zeros(len(words), dtype=np.int64)
        counts[long] = [word_count(words[i], pieces) for i in long]
        short = [i for i, w in enumerate(words) if len(w) <= LEVELS]
        counts[short] = trie_counts([words[i] for i in short], pieces)
        return counts
    order = np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)
    length = np.array([len(words[i]) for i in order], dtype=np.int64)
    flat = np.frombuffer(b"".join(words[i] for i in order), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(length)[:-1]])
    counts = np.zeros(len(words), dtype=np.int64)
    # level 0 of the word trie: the root; ``node`` is each word's node at the level reached
    alive = np.flatnonzero(length > 0)
    node = np.zeros(len(alive), dtype=np.int64)
    best, used = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    # open pieces: those that started above and go on below; their node, vocabulary state, score and count at the start
    at = state = base = taken = np.zeros(1, dtype=np.int64)
    depth = 0
    while len(alive):
        byte = flat[starts[alive] + depth].astype(np.int64)
        key = node << 8 | byte
        fresh = np.concatenate([[True], key[1:] != key[:-1]])  # words are sorted, so equal prefixes stand together
        child = np.cumsum(fresh) - 1
        parent, label = node[fresh], byte[fresh]
        n = len(parent)
        # carry each open piece to all children of its node
        by_node = np.argsort(at, kind="stable")
        low, high = np.searchsorted(at[by_node], parent, "left"), np.searchsorted(at[by_node], parent, "right")
        width = high - low
        owner = np.repeat(np.arange(n), width)
        src = by_node[np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)]
        to = pieces.advance(state[src], label[owner])
        ok = to >= 0
        owner, src, to = owner[ok], src[ok], to[ok]
        base, taken = base[src], taken[src]
        gain = base + pieces.score[to]
        done = pieces.score[to] > LOWEST
        # best score, then fewest pieces, per child
        pick = np.lexsort((taken[done], -gain[done], owner[done]))
        o = owner[done][pick]
        first = np.concatenate([[True], o[1:] != o[:-1]])
        best, used = gain[done][pick][first], taken[done][pick][first] + 1
        # pieces that start at this level's nodes
        at = np.concatenate([owner, np.arange(n)])
        state = np.concatenate([to, np.zeros(n, dtype=np.int64)])
        base, taken = np.concatenate([base, best]), np.concatenate([taken, used])
        depth += 1
        ends = length[alive] == depth
        counts[order[alive[ends]]] = used[child[ends]]
        alive, node = alive[~ends], child[~ends]
    return counts


def count_tokens(docs: DataFrame, path: str, max_distinct: int = 150_000) -> DataFrame:
    """``(doc_id, n_tokens, n_pre_tokens)`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen, counts = piece_trie(path), Interner(), np.zeros(0, dtype=np.int64)
        for batch in text_chunks(batches, 6 << 20):
            if len(seen) > max_distinct:
                seen, counts = Interner(), np.zeros(0, dtype=np.int64)
            known = len(seen)
            numbers = [np.array(seen.number(pre_tokens(text or "")), dtype=np.int32) for text in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, numbers)])
            new = seen.since(known)
            if new:
                counts = np.concatenate([counts, trie_counts([w.encode() for w in new], pieces)])
            total = np.concatenate([[0], np.cumsum(counts[np.concatenate(numbers)])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(total[ends])), pa.array(np.diff(ends))], names=["doc_id", "n_tokens", "n_pre_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_pre_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_ranks())
