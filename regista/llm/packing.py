"""Best-fit packing: pattern packing by non-negative least squares.

1. Every document becomes pieces of at most ``size`` tokens (ids, then one end token; longer ones cut so that all pieces
   but the first are full). Only the pieces' lengths and checksums leave the workers.
2. The lengths' histogram (``size`` counts, however large the corpus) goes to the driver. Few-document length patterns
   that fill a sequence are enumerated over it, non-negative least squares fits how often each repeats, the counts are
   rounded, and what they leave over is packed best-fit, longest first, on the histogram.
3. The plan is a list of runs "length l, ranks r..r+n go to slot s of sequences q..q+n"; its size depends on ``size``
   alone, so it is broadcast. Pieces get their rank within their length by two-level counting (no window over a length,
   however common it is) and look their place up.

Cases: a null text is an empty text, one piece holding the end token alone; repeated rows are packed each on its own;
ties in length are interchangeable; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regista.llm.common import materialize, stretches

#: Characters a worker handles at a time.
STRETCH = 2_000_000
#: How byte-level tokenizers cut texts into pre-tokens.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its own character where that is printable, else as one from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """Little-endian 32-bit ids of texts, as the file's tokenizer gives them; special tokens written out in a text are those
    tokens.

    Where the file is plain byte-level BPE, its vocabulary runs as byte ranks, which is several times faster. That is the
    same if the merges are listed in the order of the tokens they make and no token is made by two merges: the lowest
    listed merge and the lowest-ranked concatenation are then the same pair whenever the parts of a listed merge meet, and
    parts whose concatenation is a token but no listed merge can't meet, which ``apart`` makes sure of for every token.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = byte_ranks(spec)
        self.fast = None
        if self.ranks is not None:
            self.fast = tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=self.ranks, special_tokens={})
            self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec.get("added_tokens", [])}
            self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def one(self, text: str) -> bytes:
        if self.fast is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += [self.fast.encode_to_numpy(text[at : found.start()]).astype("<u4").tobytes(), self.special[found[0]]]
            at = found.end()
        out.append(self.fast.encode_to_numpy(text[at:] if at else text).astype("<u4").tobytes())
        return b"".join(out)


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer's file as byte ranks; None unless the file is plain byte-level BPE whose ids follow from
    the ranks alone."""
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or any(t[x] for t in added for x in ("single_word", "lstrip", "rstrip")):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"]["".join(m)] for m in merges]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return None
    byte = byte_of_char()
    raw = lambda token: bytes(map(byte.__getitem__, token))
    special = {t["content"] for t in added}
    ranks = {raw(token): i for token, i in model["vocab"].items() if token not in special}
    single = {r for r in ranks if len(r) == 1}
    if len(ranks) != len(single) + len(made) or not apart(ranks, [raw("".join(m)) for m in merges], [len(raw(m[0])) for m in merges]):
        return None
    return ranks


def apart(ranks: dict[bytes, int], tokens: list[bytes], first: list[int]) -> bool:
    """Whether merging by rank over each token's own bytes ends in that token, its last merge being the listed one. (A pair
    met inside a text with another split of the token would be met here as well, as merges look at nothing but their parts.)"""
    for token, cut in zip(tokens, first, strict=True):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
            if best[0] >= ranks[token]:
                return False
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts[0]) != cut:
            return False
    return True


_tokenizers: dict[str, Tokens] = {}


def pieces(docs: DataFrame, path: str, size: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every document's pieces; ``part`` tells tasks apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end], "<u4").tobytes()
        if path not in _tokenizers:
            _tokenizers[path] = Tokens(path)
        for whole in batches:
            for batch, some in stretches(whole, STRETCH):
                rows = []
                for doc, coded in zip(batch.column(0).to_pylist(), map(_tokenizers[path].one, some), strict=True):
                    coded += tail
                    n = len(coded) // 4
                    first = (n - 1) % size + 1
                    for k, start in enumerate([0, *range(first, n, size)]):
                        got = coded[4 * start : 4 * (start + (size if k else first))]
                        rows.append((doc, k, start, len(got) // 4, zlib.crc32(got), np.frombuffer(got, "<u4").tolist() if ids else None))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: 5 + ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, schema).withColumn("part", F.spark_partition_id())


def patterns(size: int, step: int, present: np.ndarray, most: int) -> np.ndarray:
    """Non-decreasing bucket patterns of 2..``most`` pieces that fill ``size`` (buckets are lengths rounded up to ``step``)."""
    total, out = size // step, []
    have = [b for b in range(1, total) if present[b]]
    single = set(have)
    for a in have:
        if total - a >= a and total - a in single:
            out.append((a, total - a))
    if most >= 3:
        for i, a in enumerate(have):
            for b in have[i:]:
                c = total - a - b
                if c < b:
                    break
                if c in single:
                    out.append((a, b, c))
    columns = np.zeros((total + 1, len(out)))
    for j, p in enumerate(out):
        np.add.at(columns[:, j], list(p), 1)
    return columns


def least_squares(columns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """min ||columns x - counts||, x >= 0, by accelerated projected gradients (the problem is convex)."""
    x = y = np.zeros(columns.shape[1])
    if not columns.size:
        return x
    v = np.ones(columns.shape[1])
    for _ in range(30):
        v = columns.T @ (columns @ v)
        bound = np.linalg.norm(v)
        v /= bound
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - columns.T @ (columns @ y - counts) / (1.02 * bound), 0)
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (was - 1) / t * (new - x), new
    return x


def plan(histogram: np.ndarray, size: int = 2048, step: int = 8, most: int = 3) -> np.ndarray:
    """Runs (length, first rank, number, first sequence, offset) that place every piece; ``histogram[l]`` pieces of length l."""
    left, used, runs, sequence = histogram.astype(np.int64).copy(), np.zeros(size + 1, np.int64), [], 0

    def take(length: int, number: int, at: int, offset: int) -> None:
        runs.append((length, used[length], number, at, offset))
        used[length] += number
        left[length] -= number

    if left[size]:
        sequence = int(left[size])
        take(size, sequence, 0, 0)
    bucket = (np.arange(size + 1) + step - 1) // step
    counts = np.bincount(bucket, left, size // step + 1)
    columns = patterns(size, step, counts > 0, most)
    repeats = np.floor(least_squares(columns, counts) + 0.5).astype(np.int64)
    open_: dict[int, list[tuple[int, int, int]]] = {}  # room -> [(first sequence, number, filled)]
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j] <= 0:
            break
        wanted = [b for b in range(size // step, 0, -1) for _ in range(int(columns[b, j]))]
        number = int(repeats[j])
        while number > 0:  # lengths of a bucket differ: run by run, the longest left of each bucket, best fit in the last slot
            lengths, spare, offset = [], left.copy(), 0
            for slot, b in enumerate(wanted):
                last = slot == len(wanted) - 1
                high = size - offset if last else b * step
                fits = np.flatnonzero(spare[1 if last else (b - 1) * step + 1 : high + 1])
                if not fits.size:
                    break
                length = int(fits[-1]) + (1 if last else (b - 1) * step + 1)
                spare[length] -= 1
                lengths.append(length)
                offset += length
            if len(lengths) < len(wanted):
                break
            times = min(number, *(int(left[x]) // lengths.count(x) for x in lengths))
            offset = 0
            for length in lengths:
                take(length, times, sequence, offset)
                offset += length
            if offset < size:
                open_.setdefault(size - offset, []).append((sequence, times, offset))
            sequence += times
            number -= times
    for length in range(size, 0, -1):  # the residual: best fit, longest first, equal pieces and equal gaps at a time
        while left[length]:
            room = next((r for r in range(length, size) if open_.get(r)), 0)
            if room:
                first, number, filled = open_[room].pop()
                times = min(number, int(left[length]))
                if times < number:
                    open_[room].append((first + times, number - times, filled))
            else:
                per = size // length
                times = max(1, int(left[length]) // per)
                first, filled, room = sequence, 0, size
                sequence += times
            take(length, times, first, filled)
            if room > length:
                open_.setdefault(room - length, []).append((first, times, filled + length))
    return np.array(runs, np.int64).reshape(-1, 5)


def pack(cut: DataFrame, size: int = 2048, step: int = 8, most: int = 3) -> DataFrame:
    """``cut`` (a stored table of pieces) with sequence_id and offset."""
    spark = cut.sparkSession
    counted = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(size + 1, np.int64)
    for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[row.length] = row.n
    runs = plan(histogram, size, step, most)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = spark.sparkContext.broadcast(runs)  # bounded by ``size`` and the patterns over it
    # first rank of each (part, length): a length has one row per part
    base = counted.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select("part", "length", F.coalesce("base", F.lit(0)).alias("base"))

    own = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank_in", F.row_number().over(own) - 1).join(base, ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("rank_in") + F.col("base")).drop("rank_in", "base", "part")
    names = [c for c in ranked.columns if c != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        starts = runs[:, 0] << 42 | runs[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False), np.int64) for c in ("length", "rank"))
            k = np.searchsorted(starts, length << 42 | rank, "right") - 1
            more = [pa.array(runs[k, 3] + rank - runs[k, 1]), pa.array(runs[k, 4])]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *more], names=[*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    return ranked.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """Packed pieces of all documents; with ``ids`` each piece carries its tokens, ready to be written as sequences."""
    out = pack(materialize(pieces(docs, path, size, end, ids), "pieces"), size)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids)
