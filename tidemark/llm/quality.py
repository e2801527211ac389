"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words.  Every passage becomes a vector of text statistics and of the shares of
its words that fall into each of ``BUCKETS`` hash buckets, an encoder layer turns it into a representation, gated attention gives it a weight within its document, and the weighted sum of the
representations is scored.  Encoder, attention and score are learned together from document labels.

Training takes a bounded sample of labelled documents, chosen by a hash of doc_id and never from the held-out fold: at most
``per_class`` of each label, and no more of them than hold ``max_passages`` passages together; a document that would not fit
is passed over for the next ones.  A document of the sample is taken with all its passages.  Training runs on the driver, on
the passage vectors only (4 bytes a number).  Scoring uses all
passages of the whole text and shuffles nothing.

Defined cases: null and empty texts are one passage without words; texts of any length are scored whole; documents without a
label are scored like others; several labels of one document count as their largest; labels other than 0 and 1 count as
none; without any usable labels every score is 0.5; rows that repeat, or that share a doc_id, are scored each by its own
text; a null doc_id is not held out; an empty table gives an empty result.  Other columns are passed on, but for ``score``,
``held_out`` and ``predicted``, which are replaced.  Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.hashing import word_hashes, word_spans
from tidemark.llm.shared import lean, stored, table, text_chunks

WORDS = 64
PER_CLASS, MAX_PASSAGES = 1000, 50_000
BUCKETS = 32
CHUNK = 1 << 20  # bytes of text taken apart at once; its arrays take some 40 times that
FEATURES = (
    "letters", "upper", "digits", "stops", "symbols", "bars", "marks", "non_ascii", "newlines",
    "word_length", "distinct", "repeats", "capital_starts", "symbol_ends", "single", "words",
)

_CLASS = np.zeros((9, 256), dtype=bool)
for _b in range(256):
    _c = chr(_b)
    _CLASS[0, _b] = _b >= 128 or _c.isalpha()
    _CLASS[1, _b] = _b < 128 and _c.isupper()
    _CLASS[2, _b] = _b < 128 and _c.isdigit()
    _CLASS[3, _b] = _c in ".,;:'"
    _CLASS[4, _b] = _c in "#$%&*+<=>@\\^_`{}~/[]"
    _CLASS[5, _b] = _c == "|"
    _CLASS[6, _b] = _c in '!?"()-'
    _CLASS[7, _b] = _b >= 128
    _CLASS[8, _b] = _c == "\n"


def passage_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One row of ``FEATURES`` and word buckets per passage, and the number of the text it belongs to."""
    data = [t.encode() + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(data), dtype=np.uint8)
    doc_end = np.cumsum([len(d) for d in data])
    start, end = word_spans(raw)
    doc = np.searchsorted(doc_end, start, "right")
    nth = np.arange(len(start)) - np.searchsorted(doc, doc, "left")
    fresh = nth % WORDS == 0
    passage = np.cumsum(fresh) - 1
    n = int(fresh.sum())
    owner, begin = doc[fresh], start[fresh]
    out = np.zeros((n + len(texts), len(FEATURES) + BUCKETS), dtype=np.float64)
    if n:
        stop = np.concatenate([begin[1:], [len(raw)]])
        size = np.maximum(1, stop - begin)
        for k in range(len(_CLASS)):
            hits = np.concatenate([[0], np.cumsum(_CLASS[k][raw], dtype=np.int64)])
            out[:n, k] = (hits[stop] - hits[begin]) / size
        out[:n, 1] /= np.maximum(out[:n, 0], 0.05)
        words = np.bincount(passage, minlength=n).astype(np.float64)
        mean = lambda x: np.bincount(passage, weights=x, minlength=n) / words
        h = word_hashes(raw, start, end)
        order = np.lexsort((h, passage))
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
        last = raw[end - 1]
        out[:n, 9] = mean(np.minimum(end - start, 40)) / 10
        out[:n, 10] = np.bincount(passage[order], weights=first, minlength=n) / words
        out[:n, 11] = mean(again)
        out[:n, 12] = mean(_CLASS[1][raw[start]])
        out[:n, 13] = mean(_CLASS[4][last] | _CLASS[6][last])
        out[:n, 14] = mean(end - start == 1)
        out[:n, 15] = words / WORDS
        bucket = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
        out[:n, 16:] = np.bincount(passage * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS) / words[:, None]
    bare = np.setdiff1d(np.arange(len(texts)), owner)  # texts without words: one passage of zeros
    out = out[: n + len(bare)]
    owner = np.concatenate([owner, bare]).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return out[order], owner[order]


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return _forward(self.weights, (x - self.mean) / self.scale, owner, n)["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * g) @ w["a"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, e)
    e = np.exp(e - top[owner])
    alpha = e / np.bincount(owner, weights=e, minlength=n)[owner]
    z = np.zeros((n, h.shape[1]))
    np.add.at(z, owner, alpha[:, None] * h)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return {"h": h, "t": t, "g": g, "alpha": alpha, "z": z, "p": p}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, owner: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    n = len(y)
    f = _forward(w, x, owner, n)
    dz = (f["p"] - y) / n
    dzc = dz[:, None] * w["c"]
    dh = f["alpha"][:, None] * dzc[owner]
    dalpha = (f["h"] * dzc[owner]).sum(1)
    de = f["alpha"] * (dalpha - np.bincount(owner, weights=f["alpha"] * dalpha, minlength=n)[owner])
    dt = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
    dh += dt @ w["V"].T + dg @ w["U"].T
    dx = dh * (1 - f["h"] ** 2)
    out = {"W": x.T @ dx, "b": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dz, "d": dz.sum(keepdims=True)}
    return {k: v + decay * w[k] for k, v in out.items()}


def fit(x: np.ndarray, owner: np.ndarray, y: np.ndarray, hidden: int = 24, attention: int = 12, rounds: int = 100, rate: float = 0.05, decay: float = 1e-4) -> AttentionModel:
    """Full-batch Adam from a fixed start, so reruns agree."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(7)
    d = x.shape[1]
    w = {
        "W": rng.normal(0, d**-0.5, (d, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, attention)),
        "U": rng.normal(0, hidden**-0.5, (hidden, attention)), "a": rng.normal(0, attention**-0.5, attention), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1),
    }
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    for i in range(1, rounds + 1):
        for k, g in _gradients(w, x, owner, y, decay).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
    return AttentionModel(mean, scale, w)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, quality)``: at most ``per_class`` documents of each label, outside the held-out fold."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return usable.where("quality = 0").orderBy(*order).limit(per_class).unionByName(usable.where("quality = 1").orderBy(*order).limit(per_class))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_passages: int = MAX_PASSAGES) -> AttentionModel | None:
    """The model, or None if there are not two labels.  Only passage vectors of the bounded sample reach the driver."""
    chosen = training_sample(labels, per_class)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, CHUNK):
            x, owner = passage_vectors([t or "" for t in batch.column("text").to_pylist()])
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            rows = [x[a:b].astype(np.float32).tobytes() for a, b in zip(cuts, cuts[1:])]
            columns = [batch.column("doc_id"), batch.column("quality"), pa.array(np.diff(cuts).astype(np.int32)), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "quality", "n", "x"])

    # the sample has 2 * per_class rows of two numbers at most, whatever the size of the tables
    few = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = stored(few.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(lean(vectors), "doc_id long, quality int, n int, x binary"), "passages")
    # both labels in turn, by hash; who does not fit any more is passed over
    turn = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id", "x")
    place = rows.withColumn("turn", F.row_number().over(turn))
    sizes = place.where(F.col("turn") <= per_class).select("turn", "quality", "n").collect()  # 2 * per_class rows of three numbers at most
    taken, total = [], 0
    for r in sorted(sizes):
        if total + r.n <= max_passages:
            total += r.n
            taken.append((r.quality, r.turn))
    if len({q for q, _ in taken}) < 2:
        return None
    chosen = docs.sparkSession.createDataFrame(taken, "quality int, turn int")
    rows = place.join(F.broadcast(chosen), ["quality", "turn"], "left_semi").select("doc_id", "quality", "x").toPandas()
    rows = rows.sort_values(["doc_id", "x"], kind="stable").reset_index(drop=True)
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, len(FEATURES) + BUCKETS).astype(np.float64) for b in rows.x]
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return fit(np.concatenate(bags), owner, rows.quality.to_numpy(dtype=np.float64))


def with_scores(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """``docs`` with ``score``; one score per row."""
    docs = docs.drop("held_out", "predicted")
    schema = docs.drop("score").withColumn("score", F.lit(0.5)).schema
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, CHUNK):
            n = batch.num_rows
            if model is None:
                score = np.full(n, 0.5)
            else:
                x, owner = passage_vectors([t or "" for t in batch.column("text").to_pylist()])
                score = model.score(x, owner, n)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(score, pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(lean(run), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``."""
    scored = with_scores(docs, train(docs, labels, per_class))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
