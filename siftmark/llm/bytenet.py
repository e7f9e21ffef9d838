"""Quality scores by a convolutional network over bytes, written in numpy.

Every byte has a learned vector; learned filters run over all windows of ``WIDTH`` bytes of a
text. Texts are cut into chunks that overlap by ``WIDTH - 1`` bytes, so each window of the whole
text lies in exactly one chunk. Filters are max-pooled over a chunk, a hidden layer looks at what a
chunk has and lacks (and how full it is), and the maximum and the mean of its answers over all
chunks go through a logistic layer into one probability.

A filter's answer to a window is a sum of one table row per byte (byte vectors times the filter's
weights at that place), so scoring looks up and adds. Training is Adam on a bounded sample of
labelled texts; gradients only pass through the windows that were the maximum of a chunk.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import BATCH_BYTES, pieces, small_batches, texts_of

WIDTH, VECTOR, FILTERS, HIDDEN, CHUNK = 6, 8, 24, 16, 256
#: Bounds of what is trained on: rows, and evenly spread chunks of each.
TRAIN_ROWS, TRAIN_CHUNKS = 3000, 32
EPOCHS, BATCH_ROWS, RATE, DECAY = 12, 32, 0.01, 1e-4
SEED = 13
#: Windows whose answers are held at a time.
BLOCK = 1 << 15


@dataclass
class Net:
    """Byte vectors, filter weights (place, vector, filter), hidden and logistic layer."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    dense: np.ndarray
    constant: np.ndarray

    @staticmethod
    def fresh(rng: np.random.Generator) -> Net:
        def normal(scale: float, *shape: int) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        zeros = [np.zeros(n, np.float32) for n in (FILTERS, HIDDEN, 1)]
        return Net(
            normal(0.5, 256, VECTOR), normal((WIDTH * VECTOR) ** -0.5, WIDTH, VECTOR, FILTERS), zeros[0],
            normal(FILTERS**-0.5, FILTERS + 1, HIDDEN), zeros[1], normal(0.1, 2 * HIDDEN), zeros[2],
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.weights, self.bias, self.hidden, self.hidden_bias, self.dense, self.constant]

    def tables(self) -> np.ndarray:
        """The answer of each filter to each byte at each place: (place, byte, filter)."""
        return np.einsum("bv,kvf->kbf", self.vectors, self.weights)

    def chunk_answers(self, pooled: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the hidden layer gets (filters that answer, and the share of windows that a chunk
        has) and what it answers, before its own threshold."""
        seen = np.empty((len(pooled), pooled.shape[1] + 1), np.float32)
        np.maximum(pooled + self.bias, 0, out=seen[:, :-1])
        seen[:, -1] = windows / CHUNK
        return seen, seen @ self.hidden + self.hidden_bias

    def probability(self, most: np.ndarray, mean: np.ndarray) -> np.ndarray:
        z = np.concatenate([most, mean], axis=1).astype(np.float64) @ self.dense.astype(np.float64) + self.constant[0]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The probability of each text; a text shorter than a filter is filled up with zero bytes."""
        width, filters = len(self.weights), len(self.bias)
        tables = self.tables()
        padded = [t.ljust(width, b"\0") for t in texts]
        sizes = np.fromiter((len(t) for t in padded), np.int64, len(padded))
        first = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(padded), np.uint8)
        windows = sizes - width + 1
        counts = -(-windows // CHUNK)
        owner = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = first[owner] + number * CHUNK
        end = np.minimum(start + CHUNK, (first[:-1] + windows)[owner])
        pooled = np.empty((len(owner), filters), np.float32)
        at = 0
        while at < len(owner):
            upto = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, "right")))
            low, high = int(start[at]), int(end[upto - 1])
            answers = tables[0][data[low:high]]
            for k in range(1, width):
                answers += tables[k][data[low + k : high + k]]
            # Windows between the end of a chunk and the next start lie across two texts.
            edges = np.stack([start[at:upto], end[at:upto]], axis=1).ravel() - low
            pooled[at:upto] = np.maximum.reduceat(answers, edges[:-1], axis=0)[::2]
            at = upto
        live = np.maximum(self.chunk_answers(pooled, end - start)[1], 0)
        begin = np.cumsum(counts) - counts
        if not len(texts):
            return np.empty(0)
        return self.probability(
            np.maximum.reduceat(live, begin, axis=0), np.add.reduceat(live, begin, axis=0) / counts[:, None]
        )


def _gradients(net: Net, chunks: np.ndarray, windows: np.ndarray, begin: np.ndarray, good: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy of some texts, whose chunks follow each other from ``begin`` on."""
    width = len(net.weights)
    tables = net.tables()
    answers = tables[0][chunks[:, :CHUNK]]
    for k in range(1, width):
        answers += tables[k][chunks[:, k : k + CHUNK]]
    answers[np.arange(CHUNK)[None, :] >= windows[:, None]] = -np.inf
    place = answers.argmax(axis=1)
    pooled = np.take_along_axis(answers, place[:, None, :], axis=1)[:, 0]
    seen, raw = net.chunk_answers(pooled, windows)
    live = np.maximum(raw, 0)
    counts = np.diff(np.append(begin, len(chunks)))
    owner = np.repeat(np.arange(len(begin)), counts)
    most = np.maximum.reduceat(live, begin, axis=0)
    mean = np.add.reduceat(live, begin, axis=0) / counts[:, None]
    off = ((net.probability(most, mean) - good) / len(good)).astype(np.float32)
    h = live.shape[1]
    to_mean = off[:, None] * net.dense[h:] / counts[:, None]
    # The maximum passes its gradient to the first chunk that has it.
    top = live == most[owner]
    so_far = np.cumsum(top, axis=0)
    before = np.concatenate([np.zeros((1, h), so_far.dtype), so_far])[begin]
    first = top & (so_far - before[owner] == 1)
    to_raw = ((to_mean[owner] + first * (off[:, None] * net.dense[:h])[owner]) * (raw > 0)).astype(np.float32)
    to_pooled = (to_raw @ net.hidden.T)[:, :-1] * (seen[:, :-1] > 0)
    by_table = np.zeros_like(tables)
    row, column = np.indices(place.shape)
    for k in range(width):
        np.add.at(by_table[k], (chunks[row, place + k], column), to_pooled)
    return [
        np.einsum("kbf,kvf->bv", by_table, net.weights), np.einsum("bv,kbf->kvf", net.vectors, by_table),
        to_pooled.sum(axis=0), seen.T @ to_raw, to_raw.sum(axis=0),
        np.concatenate([off @ most, off @ mean]), off.sum(keepdims=True),
    ]


def train(texts: list[list[bytes]], good: np.ndarray, seed: int = SEED) -> Net:
    """A network for texts given as lists of chunks. With labels of one kind only, or none, it
    answers the smoothed share of good ones everywhere."""
    rng = np.random.default_rng(seed)
    net = Net.fresh(rng)
    share = (good.sum() + 1) / (len(good) + 2)
    net.constant[0] = np.log(share / (1 - share))
    if good.all() or not good.any():
        net.dense[:] = 0
        return net
    width = len(net.weights)
    counts = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(counts)])
    flat = [c.ljust(width, b"\0") for t in texts for c in t]
    windows = np.array([len(c) - width + 1 for c in flat])
    chunks = np.zeros((len(flat), CHUNK + width - 1), np.uint8)
    for i, c in enumerate(flat):
        chunks[i, : len(c)] = np.frombuffer(c, np.uint8)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step, steps = 0, EPOCHS * -(-len(texts) // BATCH_ROWS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH_ROWS):
            mine = order[at : at + BATCH_ROWS]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in mine])
            begin = np.cumsum(counts[mine]) - counts[mine]
            grads = _gradients(net, chunks[rows], windows[rows], begin, good[mine].astype(np.float32))
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for p, g, (m, v) in zip(net.parameters(), grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + DECAY * p)
    return net


def _chunks(text: bytes, most: int) -> list[bytes]:
    """The chunks of a text, or ``most`` of them, evenly spread."""
    number = max(1, -(-(len(text) - WIDTH + 1) // CHUNK))
    chosen = range(number) if number <= most else [i * (number - 1) // (most - 1) for i in range(most)]
    return [text[i * CHUNK : (i + 1) * CHUNK + WIDTH - 1] for i in chosen]


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept for tests; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chunks: int = TRAIN_CHUNKS) -> Net:
    """A network trained on at most ``rows`` labelled rows that are not held out.

    The rows are those whose ids have the least hashes, whatever the order of the tables. A
    document is good if its least ``quality`` is 1; null labels and ids have no part; of rows with
    one id the least text is taken. Of a text with more than ``chunks`` chunks that many are read, spread over the whole of it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = (
        labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
        .agg((F.min("quality") == 1).alias("good")).where(~held_out(F.col("doc_id")))
        .select("doc_id", "good", F.xxhash64(F.col("doc_id").cast("string")).alias("place"))
    )
    chosen = docs.select("doc_id").distinct().join(known, "doc_id").orderBy("place", "doc_id").limit(rows)
    mine = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = mine.groupBy("doc_id", "place", "good").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([
                table["place"].combine_chunks(), table["good"].combine_chunks(),
                pa.array([_chunks(t, chunks) for t in texts_of(table["text"].combine_chunks())], pa.list_(pa.binary())),
            ], names=["place", "good", "chunks"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in b.to_pylist()]
        held.sort(key=lambda r: (r["place"], r["good"], r["chunks"]))
        net = train([r["chunks"] for r in held[:rows]], np.array([r["good"] for r in held[:rows]], bool))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    cuts = sample.mapInArrow(cut, "place bigint, good boolean, chunks array<binary>")
    return pickle.loads(cuts.repartition(1).mapInArrow(learn, "net binary").first()["net"])


def quality_scores(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    ``score`` depends on the bytes of the whole text alone; null texts score like empty ones.
    Repeated rows count each; other columns are left out, whatever their names; an empty table
    gives an empty one. A task holds about 1 MB of text, or one text if that is longer.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", 1 << 20):
            scores = shared.value.score(texts_of(table["text"].combine_chunks()))
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
