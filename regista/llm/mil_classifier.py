"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (slices of ``PASSAGE`` UTF-8 bytes). Every passage is encoded; gated attention, learnt from
document labels alone, weighs the passages; the weighted passage representation is scored. The model trains on the driver
on at most ``most`` labelled documents and ``passages`` passages chosen by hash (documented bounds; whole texts); every
passage of every document is scored in the workers. Features are byte statistics of the text alone: never labels, lang, source or ids.

Cases: a null or empty text is one empty passage and is scored like any other; null ids are scored, but never held out
nor trained on; null labels are ignored, of repeated labels the lowest counts; without both labels every score is the
share of label 1 (0.5 without any); a score depends on its text alone, so equal texts get equal scores however the rows are
partitioned; rows that repeat a document train once; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regista.llm.common import doc_key, fitting, smallest_hashes, stretches

PASSAGE = 512
#: Longer texts are encoded in blocks of so many bytes (a multiple of PASSAGE), passages scored by so many at a time, and
#: texts of so many characters met at a time.
LONG, SCORED, STRETCH = 1 << 20, 4096, 4_000_000
LAGS = 24
KINDS = 48
PAIRS = 56
WIDTH = KINDS + PAIRS + LAGS


def byte_kinds() -> np.ndarray:
    """Kinds of bytes: most ASCII marks on their own, letters and digits by group, bytes of longer characters by range."""
    kind = np.zeros(256, np.int64)
    marks = "\n \t.,;:!?#*$%&|<>-_/\\'\"()[]{}@=+~^`"
    for i, c in enumerate(marks):
        kind[ord(c)] = i + 1
    low = len(marks) + 1
    for b in range(256):
        if 48 <= b < 58:
            kind[b] = low
        elif 65 <= b < 91:
            kind[b] = low + 1
        elif 97 <= b < 123:
            kind[b] = low + 2 + (chr(b) in "aeiou")
        elif b >= 128:
            kind[b] = low + 4 + (b >= 192)
    return kind


_KIND = byte_kinds()


def encode(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, first passage of each text): shares of byte kinds and of pairs of kinds, and how often
    a byte equals the one 1..LAGS places before. Bytes of one text only: a passage looks back into the passage before it,
    never into another text."""
    raw = [t.encode("utf-8", "replace") or b"\0" for t in batch]
    if max(map(len, raw), default=0) > LONG:
        parts = [blocks(r) if len(r) > LONG else features([r])[0] for r in raw]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    return features(raw)


def blocks(raw: bytes) -> np.ndarray:
    """The features of a long text, block by block: each block but the first brings the passage before it as context."""
    out = [features([raw[:LONG]])[0]]
    for lo in range(LONG, len(raw), LONG):
        out.append(features([raw[lo - PASSAGE : lo + LONG]])[0][1:])
    return np.concatenate(out)


def features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in raw], np.int64)
    count = -(-size // PASSAGE)
    first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    start = np.concatenate([[0], np.cumsum(size)])
    inside = np.arange(len(data)) - np.repeat(start[:-1], size)
    passage = np.repeat(first[:-1], size) + inside // PASSAGE
    total = int(first[-1])
    length = np.bincount(passage, minlength=total).astype(np.float32)
    kind = _KIND[data]
    out = np.empty((total, WIDTH), np.float32)
    out[:, :KINDS] = np.bincount(passage * KINDS + kind, minlength=total * KINDS).reshape(total, KINDS)
    pair = (passage[1:] * PAIRS + (kind[:-1] * 31 + kind[1:] * 7) % PAIRS)[inside[1:] > 0]
    out[:, KINDS : KINDS + PAIRS] = np.bincount(pair, minlength=total * PAIRS).reshape(total, PAIRS)
    edges = np.searchsorted(passage, np.arange(total))
    for lag in range(1, LAGS + 1):
        same = np.zeros(len(data), np.int32)
        same[lag:] = (data[lag:] == data[:-lag]) & (inside[lag:] >= lag)
        out[:, KINDS + PAIRS + lag - 1] = np.add.reduceat(same, edges) if total else 0
    out /= np.maximum(length, 1)[:, None]
    return np.sqrt(out), first


def exact(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Product of both rounded to multiples of 2**-16: sums of integers that doubles hold exactly, so that a row's result
    doesn't depend on the rows beside it, as the order of sums in a matrix product does."""
    return np.rint(x.astype(np.float64) * 65536) @ np.rint(w.astype(np.float64) * 65536) / 2.0**32


class Model:
    """Encoder, gated attention and scorer; ``train`` fits them by Adam on whole bags."""

    NAMES = ("w", "b", "v", "u", "a", "c", "d")

    def __init__(self, width: int = WIDTH, hidden: int = 32, gate: int = 16, seed: int = 5) -> None:
        draw = np.random.default_rng(seed)
        normal = lambda *shape: (draw.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w, self.b, self.v, self.u, self.a, self.c, self.d = normal(width, hidden), np.zeros(hidden, np.float32), normal(hidden, gate), normal(hidden, gate), normal(gate), np.zeros(hidden, np.float32), np.zeros(1, np.float32)
        self.mean, self.scale, self.fixed = np.zeros(width, np.float32), np.ones(width, np.float32), None

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """``first``: the first passage of each bag, and the number of passages at the end."""
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        h, t, s, e = self.gated(x)
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        weight = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(h * weight[:, None], first[:-1])
        return bag, h, t, s, weight, z, 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))

    def gated(self, x: np.ndarray, product=np.matmul) -> tuple[np.ndarray, ...]:
        """Encoded passages, both halves of their gates, and their attention before it is shared out."""
        h = np.tanh(product(x, self.w) + self.b)
        t, s = np.tanh(product(h, self.v)), 1 / (1 + np.exp(-np.clip(product(h, self.u), -30, 30)))
        return h, t, s, (t * s * self.a).sum(1)

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of bags, each by itself: the same whatever else is in ``x``."""
        if self.fixed is not None:
            return np.full(len(first) - 1, self.fixed)
        h, e = np.empty((len(x), len(self.c))), np.empty(len(x))
        for lo in range(0, len(x), SCORED):
            h[lo : lo + SCORED], _, _, e[lo : lo + SCORED] = self.gated((x[lo : lo + SCORED] - self.mean) / self.scale, exact)
        out = np.empty(len(first) - 1)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            weight = np.exp(e[a:b] - e[a:b].max())
            out[i] = ((h[a:b] * (weight / weight.sum())[:, None]).sum(0) * self.c).sum() + self.d[0]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        bag, h, t, s, weight, z, p = self.forward(x, first)
        dp = (p - y) / len(y)
        dz = dp[:, None] * self.c
        dh = dz[bag] * weight[:, None]
        dweight = (dz[bag] * h).sum(1)
        de = weight * (dweight - np.add.reduceat(weight * dweight, first[:-1])[bag])
        dt, ds = de[:, None] * self.a * s * (1 - t * t), de[:, None] * self.a * t * s * (1 - s)
        dh = (dh + dt @ self.v.T + ds @ self.u.T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ dp, "d": np.array([dp.sum()])}

    def train(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 40, bags: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 5) -> Model:
        if len(np.unique(y)) < 2:
            self.fixed = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        x = ((x - self.mean) / self.scale).astype(np.float32)
        draw, moment = np.random.default_rng(seed), {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in self.NAMES}
        step, size = 0, np.diff(first)
        for epoch in range(epochs):
            order = draw.permutation(len(y))
            for lo in range(0, len(y), bags):
                part = order[lo : lo + bags]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
                step += 1
                for name, g in self.gradients(x[rows], np.concatenate([[0], np.cumsum(size[part])]), y[part]).items():
                    value, (m, v) = getattr(self, name), moment[name]
                    g = g + decay * value
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    value -= (rate * (1 - epoch / epochs) * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000, passages: int = 200_000, seed: int = 5, **options) -> Model:
    """Train on labelled documents that aren't held out, smallest hashes first: at most ``most`` of them, with at most
    ``passages`` passages in all (about 100 MB of features on the driver); a text that no longer fits is passed over. Rows that repeat an id and text count once."""
    spark = docs.sparkSession
    label = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    label = label.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), doc_key().alias("k"), "text").where("id IS NOT NULL")
    sized = keyed.select("id", "k", F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / PASSAGE)).alias("size"))
    sized = sized.groupBy("id", "k").agg(F.max("size").alias("size")).join(label, "id")
    rows = smallest_hashes(sized, most, seed, "id", "k").collect()  # ``most`` rows of numbers
    fits = fitting([r["size"] for r in rows], passages)
    chosen = spark.createDataFrame([(r.id, r.k, r.quality) for r, ok in zip(rows, fits, strict=True) if ok], "id long, k long, quality int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, some in stretches(whole, STRETCH):
                x, first = encode(some)
                bags = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bags, pa.binary())], names=["id", "k", "quality", "x"])

    joined = keyed.join(F.broadcast(chosen), ["id", "k"]).groupBy("id", "k", "quality").agg(F.first("text").alias("text"))
    rows = joined.select("id", "k", "quality", "text").mapInArrow(run, "id long, k long, quality int, x binary").collect()
    rows.sort(key=lambda r: (r.id, r.k))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(int)
    return Model(seed=seed).train(np.concatenate(bags) if bags else np.zeros((0, WIDTH), np.float32), first, np.array([float(r.quality > 0) for r in rows]), seed=seed, **options)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, some in stretches(whole, STRETCH):
                x, first = encode(some)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.score(x, first)), pa.array(np.diff(first))], names=["doc_id", "score", "n_passages"])

    scored = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, score double, n_passages long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
