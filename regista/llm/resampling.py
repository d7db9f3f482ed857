"""Importance resampling towards a target distribution: hashed n-gram weights, a random key, and ranks by a distributed radix sort.

Weights: every run of one to three consecutive words falls in one of ``BUCKETS`` buckets by its CRC-32. The log ratio of a
bucket's share in the target texts to its share in the documents is its gain; an array of all gains (of fixed size, so it
goes to every task) scores a document as the sum over its features. Adding a Gumbel variable that depends on the document's
id alone makes the highest scores a draw without replacement in proportion to exp(weight).

Ranks: ``radix_rank`` is a least-significant-digit radix sort. Each pass counts the digits of every block of consecutive
places, turns the counts into offsets (all smaller digits, then the same digit in earlier blocks) and sends each row to
offset + its place among the rows of its block with that digit. A pass moves rows of a few numbers once; no task gets more
than a block of one digit, however often that digit occurs, and no value is compared across tasks.

Cases: null and empty texts have no feature (weight 0) and fewer than 20 words, so they are never drawn; words of any length
and texts of any length are read in pieces; repeated ids draw the same random number, and equal rows are ranked in an
arbitrary order among themselves; a null id hashes as an empty one and sorts first; empty tables give empty results; columns
of the documents other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regista.llm.common import id_key, materialize

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
#: Bits of a digit, and the power of two of places in a block.
DIGIT, BLOCK = 12, 18
#: Bytes of text tokenized at a time.
PIECE = 1 << 20
#: Letters to lower case, digits and all bytes beyond ASCII kept, everything else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: CRC-32 of a text followed by n zero bytes is linear in the CRC of the text; words of up to _TABLED bytes are by table.
_TABLED = 48


def _shifts() -> np.ndarray:
    """[n, k, b]: what byte k of a CRC, of value b, becomes after n further bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    out = np.empty((_TABLED + 1, 4, 256), np.uint32)
    out[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(1, _TABLED + 1):
        out[n] = step[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out


class _Runs:
    """CRC-32 of word runs, each from that of the run one word shorter."""

    def __init__(self) -> None:
        self.flat = _shifts().ravel()
        self.space = zlib.crc32(b" ")

    def extend(self, before: np.ndarray, words: list[bytes], spaced: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """CRCs of ``before[i]`` + space + ``words[i]``; ``spaced`` are those of space + word, ``sizes`` their lengths."""
        base = np.minimum(sizes, _TABLED) * 1024
        out = spaced ^ self.flat[base + (before & 255)] ^ self.flat[base + 256 + ((before >> 8) & 255)] ^ self.flat[base + 512 + ((before >> 16) & 255)] ^ self.flat[base + 768 + (before >> 24)]
        for i in np.flatnonzero(sizes > _TABLED).tolist():
            out[i] = zlib.crc32(words[i], zlib.crc32(b" ", int(before[i])))
        return out

    def features(self, words: list[bytes], doc: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the runs that end at ``words[known:]``, and the document of each; runs don't cross documents."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        one = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        spaced = np.fromiter((zlib.crc32(w, self.space) for w in words), np.uint32, len(words))
        runs, at, last = [one[known:]], [doc[known:]], one
        for n in range(1, LONGEST_RUN):
            if len(words) <= n:
                break
            last = self.extend(last[:-1], words[n:], spaced[n:], sizes[n:])
            ends = (doc[n:] == doc[:-n]) & (np.arange(n, len(words)) >= known)
            runs.append(last[ends])
            at.append(doc[n:][ends])
        return np.concatenate(runs) % np.uint32(BUCKETS), np.concatenate(at)


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """(words, document of each, how many were seen before): many short texts at once, long ones cut between words with the
    last words of the piece before."""
    words, docs, size = [], [], 0
    for k, text in enumerate(texts):
        known = 0
        if len(text) > PIECE and words:
            yield words, np.repeat(*map(np.array, zip(*docs))), 0
            words, docs, size = [], [], 0
        while len(text) > PIECE:
            # a piece ends before a word that may go on; a word longer than a piece is taken whole
            cut = max(text.rfind(b" ", 0, PIECE), 0) or text.find(b" ", PIECE)
            if cut < 0:
                break
            carry = words + text[:cut].split()
            if carry:
                yield carry, np.full(len(carry), k), known
            words, text = carry[-(LONGEST_RUN - 1) :], text[cut:]
            known = len(words)
        if known:
            rest = words + text.split()
            yield rest, np.full(len(rest), k), known
            words = []
            continue
        mine = text.split()
        words += mine
        docs.append((k, len(mine)))
        size += len(text)
        if size > PIECE:
            yield words, np.repeat(*map(np.array, zip(*docs))), 0
            words, docs, size = [], [], 0
    if words:
        yield words, np.repeat(*map(np.array, zip(*docs))), 0


def _folded(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The texts' UTF-8 bytes, folded."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [(t or b"").translate(_FOLD) for t in column.to_pylist()]


def bucket_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket. A task sends one array of counts, whatever it reads."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = _Runs(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for words, doc, known in _pieces(_folded(batch, "text")):
                total += np.bincount(runs.features(words, doc, known)[0], minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> np.ndarray:
    """floor(1000 ln(ratio of a bucket's shares)), one added to every count. The driver gets at most two counts a bucket."""

    def counts(rows: DataFrame, name: str) -> list[int]:
        found = dict(bucket_counts(rows, name).collect())
        return [found.get(b, 0) for b in range(BUCKETS)]

    s, t = counts(source, text), counts(target, target_text)
    all_s, all_t = sum(s) + BUCKETS, sum(t) + BUCKETS
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, n_words, weight) of each document: the sum of its features' gains."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, worth = _Runs(), gain.astype(np.float64)  # sums stay exact below 2^53
        for batch in batches:
            n, size, total = np.zeros((3, batch.num_rows), np.int64)
            for words, doc, known in _pieces(_folded(batch, "text")):
                bucket, at = runs.features(words, doc, known)
                n += np.bincount(at, minlength=batch.num_rows)
                size += np.bincount(doc[known:], minlength=batch.num_rows)
                total += np.bincount(at, weights=worth[bucket], minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, size, total))], names=["doc_id", "n_features", "n_words", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")


def gumbel(seed: int = 42, id_col: str = "doc_id") -> F.Column:
    """floor(1000 g) of a Gumbel variable that depends on seed and id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def radix_rank(rows: DataFrame, keys: list[tuple[str, bool]], digit: int = DIGIT, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``rank`` (long, from 1) in the order of ``keys``: non-null long columns, each with True for descending.

    Digits cover what lies between a key's least and greatest value, the last key first. Rows that agree in all keys keep an
    arbitrary but fixed order. Every pass reads and writes one table; a lost executor costs that pass only."""
    columns, mark = rows.columns, f"_{uuid.uuid4().hex[:8]}"
    place, piece, value = f"place{mark}", f"block{mark}", f"digit{mark}"
    table = materialize(rows.withColumn(place, F.monotonically_increasing_id()), "radix")
    bounds = table.agg(*[f(F.col(f"`{k}`")).alias(f"{f.__name__}{i}") for i, (k, _) in enumerate(keys) for f in (F.min, F.max)]).first()
    for i, (key, down) in reversed(list(enumerate(keys))):
        low, high = bounds[f"min{i}"], bounds[f"max{i}"]
        bits = 0 if low is None else (high - low).bit_length()
        # what lies between is below 2^64; as an unsigned number it is shifted without its sign
        offset = (F.lit(high) - F.col(f"`{key}`")) if down else (F.col(f"`{key}`") - F.lit(low))
        if bits > 63:  # by decimals, as the difference is no long; its bits are then taken as those of a long
            ends = (f"{high}BD", f"`{key}`") if down else (f"`{key}`", f"{low}BD")
            offset = F.expr(f"cast({ends[0]} as decimal(20)) - cast({ends[1]} as decimal(20))")
            offset = F.when(offset >= F.expr("9223372036854775808BD"), offset - F.expr("18446744073709551616BD")).otherwise(offset).cast("long")
        for shift in range(0, bits, digit):
            table = _pass(table, F.shiftrightunsigned(offset, shift).bitwiseAND(F.lit((1 << digit) - 1)), block, place, piece, value)
    if not any(c is not None for c in bounds):
        return table.select(*[F.col(f"`{c}`") for c in columns], F.lit(None).cast("long").alias("rank"))
    if all(bounds[f"min{i}"] == bounds[f"max{i}"] for i in range(len(keys))):  # nothing to sort, but places still have gaps
        table = _pass(table, F.lit(0), block, place, piece, value)
    return table.select(*[F.col(f"`{c}`") for c in columns], (F.col(place) + 1).alias("rank"))


def _pass(table: DataFrame, digit: F.Column, block: int, place: str, piece: str, value: str) -> DataFrame:
    """One stable counting sort: ``place`` becomes the place among all rows by digit, then by the place before."""
    from pyspark.sql import Window as W

    spark = table.sparkSession
    rows = table.withColumns({value: digit.cast("int"), piece: F.shiftright(place, block)})
    counts = materialize(rows.groupBy(value, piece).agg(F.count(F.lit(1)).alias("n")), "radix-counts")
    # at most 2^digit totals, one for each digit: a bounded table
    totals, first = sorted(counts.groupBy(value).agg(F.sum("n")).collect()), []
    for d, n in totals:
        first.append((d, sum(first[-1][1:]) if first else 0, n))
    first = spark.createDataFrame([(d, before) for d, before, _ in first], f"{value} int, before long")
    same = F.sum("n").over(W.partitionBy(value).orderBy(piece)) - F.col("n")
    offsets = counts.join(F.broadcast(first), value).select(value, piece, (F.col("before") + same).alias("offset"))
    within = F.row_number().over(W.partitionBy(value, piece).orderBy(place)) - 1
    moved = rows.withColumn("within", within).join(offsets.hint("merge"), [value, piece])
    return materialize(moved.withColumn(place, F.col("offset") + F.col("within")).select(*[F.col(f"`{c}`") for c in table.columns]), "radix")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, id_col: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank (null: not drawn). ``percent`` of the documents with
    ``LEAST_WORDS`` words are drawn, highest scores first, ties to the smaller id. Any column may hold nulls."""
    scored = weighted(docs, gains(docs, target, text, target_text), id_col, text)
    scored = materialize(scored.withColumn("score", F.col("weight") + gumbel(seed)).withColumn("key", id_key("doc_id")), "resample")
    fit = scored.where(F.col("n_words") >= LEAST_WORDS)
    drawn = fit.count() * percent // 100
    ranked = radix_rank(fit, [("score", True), ("key", False)])
    out = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.where(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, id_col: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """The drawn documents, all their columns kept, for training on. Ids must be unique and not null."""
    ids = resample(docs, target, percent, seed, id_col, text, target_text).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn"))
    return docs.join(ids.hint("merge"), docs[id_col].cast("long") == F.col("_drawn")).drop("_drawn")
