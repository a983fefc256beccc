"""Document quality by a byte-level convolutional network in numpy.

Each byte has a learned vector of EMBED numbers. FILTERS learned filters read
WIDTH bytes every STRIDE bytes over the whole text. Activations are max-pooled
over overlapping chunks of two SEGMENTs of filter positions, each chunk beginning
where the last one's second half began, so every position lies in some chunk.
HIDDEN units read the maxima of each chunk, so that what a chunk lacks can count too
(a text that repeats a few words shows few patterns). Maxima and units are
max-pooled and averaged over all chunks, which tells whether and how often
something occurs, and a logistic layer makes one probability of these numbers.

The network is fitted on at most SAMPLE labelled documents, those with the
smallest hashes of doc_id, and never on held-out ones; inputs are the texts alone.

Defined cases: null and empty texts are scored as no bytes (padding only); labels
that are null or whose document is missing are ignored; repeated label rows count
once for each value; with no labelled rows, or one label only, every score is the
share of label 1 (0.5 if there is none); an empty table gives none; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import small_batches, string_buffers

SAMPLE = 3000
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN, SEGMENT = 8, 8, 2, 24, 16, 64
SPAN = STRIDE * SEGMENT  # bytes from one chunk to the next
EPOCHS, BATCH, RATE = 8, 32, 0.005
LEAST_STEPS, MOST_EPOCHS = 600, 40  # small samples are gone over more often
THRESHOLD = 0.3


def held_out(doc_id: Column, remainder: int = 0) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == remainder


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each after WIDTH zeros and before zeros up to whole segments, and the first segment of each.

    A window that begins in a text's last segment so reads zeros beyond it, whatever text comes next.
    """
    lengths = np.diff(offsets)
    segments = np.maximum(1, -(-(lengths + WIDTH) // SPAN))
    first = np.concatenate([[0], np.cumsum(segments)])
    out = np.zeros(first[-1] * SPAN + WIDTH, np.uint8)
    shift = np.repeat(first[:-1] * SPAN + WIDTH - offsets[:-1], lengths)
    out[np.arange(len(data)) + shift] = data
    return out, first


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "emb": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "conv": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "deep": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32),
            "deep_bias": np.full(HIDDEN, 0.5, np.float32),
            "out": np.zeros(2 * (FILTERS + HIDDEN), np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.p["emb"][0] = 0
        self.constant: float | None = None

    def segments(self, data: np.ndarray, keep: bool = False):
        """The largest activation of each filter in each segment, and where it is if asked."""
        n = (len(data) - WIDTH) // SPAN
        best, at = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if keep else None
        step = 1024
        for i in range(0, n, step):
            m = min(step, n - i)
            vectors = self.p["emb"][data[i * SPAN : (i + m) * SPAN + WIDTH]]
            windows = np.lib.stride_tricks.as_strided(vectors, (m * SEGMENT, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))
            act = (np.ascontiguousarray(windows) @ self.p["conv"]).reshape(m, SEGMENT, FILTERS)
            best[i : i + m] = act.max(axis=1)
            if keep:
                at[i : i + m] = act.argmax(axis=1)
        best += self.p["bias"]
        return np.maximum(best, 0), at

    def features(self, best: np.ndarray, first: np.ndarray):
        """Chunk maxima (of two neighbouring segments of one text) and units, then the largest and mean of each for each text."""
        last = first[1:] - 1
        chunk = best.copy()
        inner = np.ones(len(best), bool)
        inner[last] = False
        i = np.flatnonzero(inner)
        second = np.zeros(best.shape, bool)
        second[i] = best[i + 1] > best[i]
        chunk[i] = np.maximum(best[i], best[i + 1])
        both = np.concatenate([chunk, np.maximum(chunk @ self.p["deep"] + self.p["deep_bias"], 0)], axis=1)
        size = np.diff(first)[:, None]
        return both, second, np.concatenate([np.maximum.reduceat(both, first[:-1]), np.add.reduceat(both, first[:-1]) / size], axis=1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        data, first = padded(data, offsets)
        _, _, x = self.features(self.segments(data)[0], first)
        z = (x @ self.p["out"] + self.p["out_bias"]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, data: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        data, first = padded(data, offsets)
        best, at = self.segments(data, keep=True)
        both, second, x = self.features(best, first)
        z = np.clip(x @ self.p["out"] + self.p["out_bias"], -30, 30)
        dz = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        g = {"out": x.T @ dz, "out_bias": dz.sum(keepdims=True)}
        dx = dz[:, None] * self.p["out"]
        size = np.diff(first)
        width = FILTERS + HIDDEN
        d_both = np.repeat(dx[:, width:] / size[:, None], size, axis=0)
        top = (both == np.repeat(x[:, :width], size, axis=0)).astype(np.float32)
        top /= np.add.reduceat(top, first[:-1])[np.repeat(np.arange(len(size)), size)]  # chunks that share the largest value share its gradient
        d_both += top * np.repeat(dx[:, :width], size, axis=0)
        d_unit = d_both[:, FILTERS:] * (both[:, FILTERS:] > 0)
        g["deep"], g["deep_bias"] = both[:, :FILTERS].T @ d_unit, d_unit.sum(axis=0)
        d_chunk = d_both[:, :FILTERS] + d_unit @ self.p["deep"].T
        d_best = np.where(second, 0, d_chunk)
        d_best[1:] += np.where(second[:-1], d_chunk[:-1], 0)
        d_best *= best > 0
        g["bias"] = d_best.sum(axis=0)
        seg, f = np.nonzero(d_best)
        d = d_best[seg, f]
        start = seg * SPAN + at[seg, f] * STRIDE
        taken = data[start[:, None] + np.arange(WIDTH)]
        patches = self.p["emb"][taken].reshape(len(start), -1)
        order = np.argsort(f, kind="stable")
        bounds = np.searchsorted(f[order], np.arange(FILTERS + 1))
        conv = np.zeros_like(self.p["conv"])
        for k in range(FILTERS):
            rows = order[bounds[k] : bounds[k + 1]]
            conv[:, k] = d[rows] @ patches[rows]
        g["conv"] = conv
        back = (d[:, None] * self.p["conv"].T[f]).reshape(-1, EMBED)
        flat = taken.ravel()
        g["emb"] = np.stack([np.bincount(flat, back[:, e], 256) for e in range(EMBED)], axis=1).astype(np.float32)
        g["emb"][0] = 0
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
        share = float(labels.mean()) if len(labels) else 0.5
        if len(set(labels.tolist())) < 2:
            self.constant = share
            return self
        self.p["out_bias"][:] = np.log(share / (1 - share))
        rng = np.random.default_rng(seed)
        self.p["out"][:] = rng.normal(0, 0.1, 2 * (FILTERS + HIDDEN))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        batches = -(-len(texts) // BATCH)
        epochs = max(epochs, min(MOST_EPOCHS, -(-LEAST_STEPS // batches)))
        turn, total = 0, epochs * batches
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                data = np.frombuffer(b"".join(texts[k] for k in some), np.uint8)
                offsets = np.concatenate([[0], np.cumsum([len(texts[k]) for k in some])])
                turn += 1
                rate = RATE * (1 - turn / (total + 1)) * (1 - 0.999**turn) ** 0.5 / (1 - 0.9**turn)
                for k, g in self.gradients(data, offsets, labels[some]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Network:
    """A network for ``labels.quality``, from at most ``sample`` labelled rows that are not held out."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)").distinct()
    chosen = marked.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").toArrow()  # ``sample`` documents at most
    rows = rows.sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    texts = [(x or "").encode() for x in rows["text"].to_pylist()]
    return Network().fit(texts, rows["quality"].to_numpy().astype(np.float32), epochs)


def score_quality(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(*string_buffers(batch.column(1))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at):
            yield batch.filter(pa.array(shared.value.score(*string_buffers(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
