"""Suffix-array dedup of repeated byte strings by prefix-free parsing.

The text's UTF-8 bytes are parsed at triggers: places where a rolling hash of ``K`` bytes is the least among all places of
some ``length``-byte string. The trigger of a string depends on its bytes alone, so equal strings have equal triggers at
equal offsets, and every string of ``length`` bytes has exactly one. A phrase is a trigger's run of consecutive starts
together with the bytes up to the end of the last start's string; it carries ``length - 1`` bytes of the parse after it,
so all suffixes that start in it are in order, up to ``length`` bytes, by the phrase's own bytes. Corpus order further on
is never needed: a string repeats when two suffixes agree in their first ``length`` bytes.

1. Parse occurrences (document, place, trigger hash, hash of the phrase's bytes) are kept where the trigger occurs at least
   twice. A phrase that equals the one before it byte for byte (periodic text) is a later copy outright and goes into a
   run, so that a run of one byte, however long, gives one phrase and one run.
2. The dictionary holds each distinct phrase once, with its first occurrence. Every other occurrence of a phrase is a
   later copy outright: all its starts are repeats.
3. The suffix array of the dictionary is built in buckets of triggers (suffixes with different triggers never agree):
   starts sorted by their bytes, then by place; a start whose string equals that of an earlier one is a repeat. Phrases
   whose trigger no other phrase shares need no sorting. A trigger with more than ``hot`` distinct phrases would fill its
   bucket, so its starts are dealt out by their strings' 128-bit hashes instead.
4. Repeats of dictionary and parse meet again per document, where their bytes are removed.

Cases: a null or empty text has no bytes; texts shorter than ``length`` stay whole; rows of one doc_id with different texts
are ordered by the text's hash, and rows repeated whole count as one document, so that all of them get its result; null
ids sort first; overlapping repeats, also within one text, all count; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regista.llm.common import NULL_ID, doc_key, id_key, materialize, texts

LENGTH = 100
K = 37
#: Bytes parsed at a time (a longer text comes in pieces), dictionary phrases sorted at a time, and starts in a row.
PARSE, BUCKET, MOST = 2_000_000, 2_000, 60_000
RUN = 0
NAMES = ["d", "k", "q", "key", "phrase", "n"]

_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_M), -1, 2**64))
_power: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling hash's base and of its inverse, modulo 2^64."""
    if len(_power.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _M), ("down", _INVERSE)):
                _power[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, PARSE + 300_000) - 1, base)]))
    return _power["up"][:n], _power["down"][:n]


_TABLE = np.random.default_rng(23).integers(0, 2**63, (2, 256), dtype=np.uint64)[0] * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def prefix_sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * up)])


def pieces(raw: list[bytes], length: int = LENGTH, most: int = PARSE) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, place, bytes) lists to be parsed together, of about ``most`` bytes. A longer text comes in pieces that overlap
    by ``length - 1`` bytes, so that each of its strings is in one piece; a phrase on the border becomes two."""
    some, total = [], 0
    for i, r in enumerate(raw):
        for lo in range(0, max(1, len(r) - length + 1), most):
            part = r[lo : lo + most + length - 1]
            if some and total + len(part) > most:
                yield some
                some, total = [], 0
            some.append((i, lo, part))
            total += len(part)
    if some:
        yield some


def parse(some: list[tuple[int, int, bytes]], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, trigger's offset from the first start, trigger hash, phrase hash, whether it
    is the same as the phrase before it) of all phrases."""
    texts_, places = np.array([x[0] for x in some], np.int64), np.array([x[1] for x in some], np.int64)
    size = np.array([len(x[2]) for x in some], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    joined = b"".join(x[2] for x in some)
    data = np.frombuffer(joined, np.uint8)
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2)) + (np.zeros(0, bool),)
    _, down = powers(n + 1)
    trigger = prefix_sums(data, _TABLE)
    trigger = mixed((trigger[k:] - trigger[:-k]) * down[: n - k + 1])
    # the least (hash, place) among the k-grams of each string
    least = (trigger & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(trigger), dtype=np.uint64)
    width, window = 1, length - k + 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    piece = np.repeat(np.arange(len(size)), size)
    whole = piece[: len(at)] == piece[length - 1 : length - 1 + len(at)]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (piece[1 : len(at)] != piece[: len(at) - 1])
    first = np.flatnonzero(new & whole)
    breaks = np.append(np.flatnonzero(new | ~whole), len(at))
    end = breaks[np.searchsorted(breaks, first, "right")]
    number, offset = end - first, at[first] - first
    phrase = np.fromiter(map(xxhash.xxh3_64_intdigest, [joined[a:b] for a, b in zip(first.tolist(), (end + length - 1).tolist(), strict=True)]), np.uint64, len(first))
    phrase = mixed(phrase + number.astype(np.uint64) * np.uint64(7919) + offset.astype(np.uint64))
    owner = piece[first]
    again = np.zeros(len(first), bool)
    if len(first):
        again[1:] = (phrase[1:] == phrase[:-1]) & (first[1:] == end[:-1]) & (owner[1:] == owner[:-1])
        for i in np.flatnonzero(again).tolist() if again.sum() < 64 else ():
            again[i] = joined[first[i] : end[i] + length - 1] == joined[first[i - 1] : end[i - 1] + length - 1]
        if again.sum() >= 64:
            for step in np.unique(number[again]).tolist():  # at most ``length`` periods
                differ = np.append(0, np.cumsum(data[step:] != data[:-step]))
                here = np.flatnonzero(again & (number == step))
                again[here] = differ[end[here] + length - 1 - step] == differ[first[here] - step]
    return texts_[owner], places[owner] + first - start[owner], number, offset, trigger[at[first]], phrase, again


def occurrences(docs: DataFrame) -> DataFrame:
    """(d, k, q, key, phrase, n): the parse. ``q`` packs first start, number of starts and trigger offset, in this order. A
    phrase that repeats the one before it byte for byte is a later copy outright, and no other copy needs it; runs of such
    phrases, as periodic text has them, become rows (p in place of q) with n, their number of starts, under the key RUN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode("utf-8", "replace") for t in texts(batch)]
            d, k = (batch.column(i).to_numpy() for i in (0, 1))
            for some in pieces(raw):
                owner, first, number, offset, key, phrase, again = parse(some)
                cols = [x[~again] for x in (d[owner], k[owner], first << 16 | number << 8 | offset, key.view(np.int64), phrase.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(len(cols[0]), pa.int64())], names=NAMES)
                if again.any():
                    begin = np.flatnonzero(again & ~np.append(False, again[:-1]))
                    total = np.add.reduceat(np.where(again, number, 0), begin)
                    cut = -(-total // MOST)  # rows of at most MOST starts
                    part = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
                    cols = [np.repeat(d[owner[begin]], cut), np.repeat(k[owner[begin]], cut), np.repeat(first[begin], cut) + part * MOST]
                    n = np.minimum(np.repeat(total, cut) - part * MOST, MOST)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.full(len(n), RUN)), pa.nulls(len(n), pa.int64()), pa.array(n)], names=NAMES)

    return docs.select(id_key("doc_id").alias("d"), doc_key().alias("k"), "text").mapInArrow(run, "d long, k long, q long, key long, phrase long, n long")


def phrase_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(d, k, q, key, m, bytes) of the phrases in ``wanted`` (d, k, list of q, key, m)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds, ks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for d, k, text, some in zip(ds, ks, texts(batch), batch.column(3), strict=True):
                raw, some = text.encode("utf-8", "replace"), some.values
                q = some.field("q").to_numpy()
                place, number = q >> 16, (q >> 8) & 255
                data = [raw[a : a + n + LENGTH - 1] for a, n in zip(place.tolist(), number.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q), d)), pa.array(np.full(len(q), k)), some.field("q"), some.field("key"), some.field("m"), pa.array(data, pa.binary())], names=["d", "k", "q", "key", "m", "bytes"]
                )

    rows = docs.select(id_key("doc_id").alias("d"), doc_key().alias("k"), "text").join(wanted.hint("merge"), ["d", "k"])
    return rows.select("d", "k", "text", "some").mapInArrow(run, "d long, k long, q long, key long, m long, bytes binary")


def windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start in it, string) of every start of some phrases' bytes."""
    number = np.array([len(r) - LENGTH + 1 for r in raw], np.int64)
    begin = np.concatenate([[0], np.cumsum([len(r) for r in raw])])[:-1]
    phrase = np.repeat(np.arange(len(raw)), number)
    inside = np.arange(len(phrase)) - np.repeat(np.cumsum(number) - number, number)
    data = np.frombuffer(b"".join(raw), np.uint8)
    strings = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[begin[phrase] + inside]
    return phrase, inside, strings


def sort_suffixes(table: pa.Table) -> pa.Table:
    """Later copies (d, k, p, n) among the starts of one bucket of the dictionary, as runs of n starts from p on."""
    get = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    d, k, place = get("d"), get("k"), get("q") >> 16
    phrase, inside, strings = windows(table.column("bytes").to_pylist())
    # places in the order of the corpus; rows that repeat a document share theirs
    by_place = np.lexsort((place, k, d))
    same = (d[by_place][1:] == d[by_place][:-1]) & (k[by_place][1:] == k[by_place][:-1]) & (place[by_place][1:] == place[by_place][:-1])
    order = np.empty(len(d), np.int64)
    order[by_place] = np.concatenate([[0], np.cumsum(~same)]) if len(d) else []
    suffix = np.ascontiguousarray(strings).view(f"S{LENGTH}").ravel()  # all of one length, so padding changes no order
    rank = np.argsort(suffix)
    group = np.concatenate([[0], np.cumsum(suffix[rank][1:] != suffix[rank][:-1])]) if len(rank) else rank
    earliest = np.full(int(group[-1]) + 1 if len(group) else 0, len(d))
    np.minimum.at(earliest, group, order[phrase[rank]])
    later = np.zeros(len(phrase), bool)
    later[rank] = order[phrase[rank]] > earliest[group]
    return runs(d, k, place, phrase, inside, later)


def runs(d: np.ndarray, k: np.ndarray, place: np.ndarray, phrase: np.ndarray, inside: np.ndarray, later: np.ndarray) -> pa.Table:
    hit = np.flatnonzero(later)
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > 1) | (phrase[hit][1:] != phrase[hit][:-1])
    begin = np.flatnonzero(new)
    number = np.diff(np.append(begin, len(hit)))
    of = phrase[hit[begin]]
    return pa.table({"d": d[of], "k": k[of], "p": place[of] + inside[hit[begin]], "n": number})


def hashed_starts(rows: DataFrame) -> DataFrame:
    """(d, k, p, h, g) of every start of hot triggers' phrases: its place and its string's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                d, k, q = (part.column(i).to_numpy() for i in range(3))
                phrase, inside, strings = windows(part.column(3).to_pylist())
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in strings]
                pair = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                cols = [d[phrase], k[phrase], (q[phrase] >> 16) + inside, pair[:, 0], pair[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["d", "k", "p", "h", "g"])

    return rows.select("d", "k", "q", "bytes").mapInArrow(run, "d long, k long, p long, h long, g long")


def repeats(docs: DataFrame, hot: int = 1000) -> DataFrame:
    """(d, k, p, n): runs of n starts from p on whose ``LENGTH`` bytes also start earlier."""
    whole = occurrences(docs)
    keys = materialize(whole.groupBy("key").count().where(f"count > 1 OR key = {RUN}").select("key"), "triggers")
    kept = materialize(whole.join(keys.hint("merge"), "key"), "parse")
    parsed = kept.where("n IS NULL").drop("n")
    first = parsed.groupBy("key", "phrase").agg(F.min(F.struct("d", "k", "q")).alias("first"))
    dictionary = materialize(first, "dictionary")
    copies = parsed.join(dictionary.hint("merge"), ["key", "phrase"]).where(F.struct("d", "k", "q") != F.col("first"))
    copies = copies.select("d", "k", F.shiftright("q", 16).alias("p"), F.shiftright("q", 8).bitwiseAND(F.lit(255)).alias("n"))

    shared = materialize(dictionary.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    listed = dictionary.join(shared.hint("merge"), "key").select("first.d", "first.k", F.struct("first.q", "key", "m").alias("one"))
    wanted = listed.groupBy("d", "k").agg(F.collect_list("one").alias("some"))  # phrases of one document
    rows = materialize(phrase_bytes(docs, wanted), "phrases")
    number = rows.where(F.col("m") <= hot).count()
    bucket = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-number // BUCKET))))
    sorted_ = rows.where(F.col("m") <= hot).select(bucket.alias("bucket"), "d", "k", "q", "bytes").groupBy("bucket").applyInArrow(sort_suffixes, "d long, k long, p long, n long")

    starts = materialize(hashed_starts(rows.where(F.col("m") > hot)), "starts")
    least = starts.groupBy("h", "g").agg(F.min(F.struct("d", "k", "p")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    later = starts.join(materialize(least, "least").hint("merge"), ["h", "g"]).where(F.struct("d", "k", "p") != F.col("first")).select("d", "k", "p", F.lit(1).cast("long").alias("n"))
    return copies.unionByName(sorted_).unionByName(later).unionByName(kept.where("n IS NOT NULL").select("d", "k", F.col("q").alias("p"), "n"))


def dedup(docs: DataFrame, hot: int = 1000, kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``kept`` also the remaining bytes and the spans."""
    listed = repeats(docs, hot).groupBy("d", "k").agg(F.collect_list(F.shiftleft("p", 16).bitwiseOR(F.col("n"))).alias("gone"))  # of one document
    gone = materialize(listed, "gone")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, text, some in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2), strict=True):
                raw = text.encode("utf-8", "replace")
                left, spans = raw, np.zeros((0, 2), np.int64)
                if some.is_valid:
                    packed = np.sort(some.values.to_numpy())
                    begin, end = packed >> 16, (packed >> 16) + (packed & 0xFFFF) + LENGTH - 1
                    reach = np.maximum.accumulate(end)
                    new = np.append(True, begin[1:] > reach[:-1])
                    at = np.flatnonzero(new)
                    spans = np.stack([begin[at], np.maximum.reduceat(end, at)], 1)
                    edges = [0, *spans.ravel().tolist(), len(raw)]
                    left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((None if d == NULL_ID else d, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left, spans.tolist()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(len(names))], names=names)

    rows = docs.select(id_key("doc_id").alias("d"), doc_key().alias("k"), "text").join(gone.hint("merge"), ["d", "k"], "left").select("d", "text", "gone")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<array<long>>" * kept)
