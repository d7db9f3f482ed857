"""Quality rules judged by an isolation forest.

Rule statistics are measured on every whole text. Two base rules reject outright; for the rest an isolation forest over
scale-free statistics gives an anomaly score: documents that few random splits isolate have short paths. Each tree grows
on ``tree_rows`` rows (a parameter of the method: the forest sees ``trees * tree_rows`` rows chosen by hash, 25,600 as
set, whatever the corpus); every document is scored, and the rejection threshold comes from all labelled rows.

Cases: a null text has no words and fails the base rule; null ids and labels are allowed (such labels are ignored; of
repeated labels the lowest counts); equal texts get equal verdicts; without labels the threshold is ``threshold``;
an empty table gives an empty result; further columns pass through ``keep_good`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regista.llm.common import materialize, smallest_hashes, texts

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
BINS = 4096
#: Shares below which a statistic says nothing against a text.
TOLERATED = {"symbols": 0.05, "dup_lines": 0.35, "repeat_words": 0.25, "upper": 0.15, "digits": 0.15, "marks": 0.1}


def repeat_words(words: list[bytes], ids: dict[bytes, int]) -> int:
    """Words inside ``WINDOW``-word windows that occur at least twice in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    for w in words:
        if w not in ids:
            ids[w] = len(ids)
    code = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    name, span = code, 1
    while span < WINDOW:  # exact names of 2-, 4-, 8-word windows
        pair = name[:-span] * (int(name.max()) + 1) + name[span:]
        span *= 2
        if span < WINDOW:
            name = np.unique(pair, return_inverse=True)[1]
    order = np.argsort(pair, kind="stable")
    same = pair[order[1:]] == pair[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n + 1, np.int64)
    twice = np.zeros(len(pair), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    start = np.flatnonzero(twice)
    np.add.at(hit, start, 1)
    np.add.at(hit, start + WINDOW, -1)
    return int((np.cumsum(hit)[:n] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The statistics of one text, in the order of STATS."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    ids: dict[bytes, int] = {}
    repeated = repeat_words(words, ids)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), int(counts[[ord(c) for c in SYMBOLS]].sum()), len(lines) - len(set(lines)), repeated,
        len(lines), len(ids) if ids else len(set(words)), int(counts[65:91].sum()), int(counts[48:58].sum()), int(counts[[ord(c) for c in "!?"]].sum()),
    )


def features(s: np.ndarray) -> np.ndarray:
    """Scale-free rule statistics of rows of STATS. Shares that clean prose shows too (a repeated heading, a quoted
    passage, numbers) count by what they exceed TOLERATED, else a forest isolates documents for having any at all."""
    words, chars, symbols, dup, repeat, lines, distinct, upper, digits, marks = s.T.astype(float)
    one = lambda x: np.maximum(x, 1)
    variety = np.log1p(distinct) / np.log1p(one(words))
    over = lambda name, share: np.maximum(share - TOLERATED[name], 0)
    return np.stack([
        chars / one(words), over("symbols", symbols / one(words)), over("dup_lines", dup / one(lines)), over("repeat_words", repeat / one(words)),
        np.minimum(variety, 0.9), over("upper", upper / one(chars)), over("digits", digits / one(chars)), over("marks", marks / one(words)),
    ], 1)


class Forest:
    """Isolation trees as flat arrays."""

    def __init__(self, rows: np.ndarray, trees: int, tree_rows: int, seed: int) -> None:
        draw = np.random.default_rng(seed)
        order = draw.permutation(len(rows))
        per = max(1, min(tree_rows, len(rows)))
        self.norm = self.depth_of(per)
        self.height = max(1, int(np.ceil(np.log2(max(2, per)))))
        self.trees = [self.grow(rows[np.take(order, range(t * per, (t + 1) * per), mode="wrap")], draw) for t in range(trees)] if len(rows) else []

    @staticmethod
    def depth_of(n: int) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(self, rows: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, split, left, right, path = [], [], [], [], []

        def node(x: np.ndarray, depth: int) -> int:
            k = len(feature)
            for column in (feature, left, right):
                column.append(-1)
            split.append(0.0)
            path.append(depth + self.depth_of(len(x)))
            low, high = x.min(0), x.max(0)
            able = np.flatnonzero(high > low)
            if depth < self.height and len(x) > 1 and able.size:
                f = int(draw.choice(able))
                split[k], feature[k] = draw.uniform(low[f], high[f]), f
                under = x[:, f] < split[k]
                left[k], right[k] = node(x[under], depth + 1) if under.any() else leaf(depth + 1), node(x[~under], depth + 1)
            return k

        def leaf(depth: int) -> int:
            for column, value in ((feature, -1), (left, -1), (right, -1), (split, 0.0), (path, float(depth))):
                column.append(value)
            return len(feature) - 1

        node(rows, 0)
        return np.array(feature), np.array(split), np.array(left), np.array(right), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in 0..1 of each row: 2 to the power of minus the mean path over the expected one."""
        if not self.trees:
            return np.full(len(x), 0.5)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, left, right, path in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.height):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, np.where(x[rows, np.maximum(f, 0)] < split[at], left[at], right[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self.norm, 1e-9))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t) for t in texts(batch)], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], names=["doc_id", *STATS])

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))


def base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < 20) | (100 * s[:, 4] > 30 * s[:, 0])


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(forest)  # bounded by trees and tree_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(STATS))], 1)
            more = [pa.array(base_failed(s)), pa.array(shared.value.score(features(s)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["doc_id", *STATS, "base_failed", "anomaly"])

    return stats.select("doc_id", *STATS).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, anomaly double")


def calibrate(rated: DataFrame, labels: DataFrame, cost: float, threshold: float) -> float:
    """The anomaly above which rejecting labelled rows pays: one clean row lost weighs ``cost`` junk rows caught.
    Counts of all labelled rows by score go to the driver: two numbers for each of BINS bins."""
    label = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    seen = rated.where(~F.col("base_failed")).select("doc_id", F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")).join(label, "doc_id")
    count = np.zeros((2, BINS + 1))
    for row in seen.groupBy("bin", (F.col("quality") > 0).cast("int").alias("good")).count().collect():
        count[row.good, row.bin] = row["count"]
    if not count.sum(1).all():
        return threshold
    above = count[:, ::-1].cumsum(1)[:, ::-1] / count.sum(1, keepdims=True)
    gain = above[0] - cost * above[1]
    return int(gain.argmax()) / BINS


def fit(docs: DataFrame, labels: DataFrame, trees: int = 100, tree_rows: int = 256, cost: float = 10.0, threshold: float = 0.6, seed: int = 7) -> tuple[DataFrame, Forest, float]:
    """(scored statistics of all documents, forest, threshold)."""
    stats = materialize(statistics(docs), "rules")
    # rows that repeat a document count once, so that no group of them fills the sample
    sample = smallest_hashes(stats.where("n_words >= 20").distinct(), trees * tree_rows, seed, "doc_id", *STATS)
    rows = np.array([tuple(r) for r in sample.select(*STATS).collect()], np.int64).reshape(-1, len(STATS))
    forest = Forest(features(rows[~base_failed(rows)]), trees, tree_rows, seed)
    rated = scored(stats, forest)
    return rated, forest, calibrate(rated, labels, cost, threshold)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, statistics, base_failed, anomaly and kept of every document."""
    rated, _, threshold = fit(docs, labels, **options)
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with all their columns; texts are not shuffled."""
    _, forest, threshold = fit(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([measure(t) for t in texts(batch)], np.int64).reshape(-1, len(STATS))
            yield batch.filter(pa.array(~base_failed(s) & (shared.value.score(features(s)) < threshold)))

    return docs.mapInArrow(run, docs.schema)
