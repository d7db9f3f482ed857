"""Phrase collocations: frequent word sequences by a distributed multikey quicksort of suffixes, scored by their weakest cut.

Texts are folded (A-Z to lower case), cut into pieces at punctuation and line ends, and pieces into words. A suffix starts
at a word and reaches to the end of its piece, ``DEPTH`` words at most. Three steps count every phrase of two to ``DEPTH``
words that occurs at least ``least`` times in its language:

1. ``survey``: words are counted exactly, and word pairs, triples and quadruples by hash in tables of fixed size. An entry
   is never below the count of a sequence that falls in it, so a pair whose entry is small is certainly infrequent.
2. ``suffixes``: each suffix ends before its first infrequent pair; what is left with two words or more is sent where its
   leading words say: by two words, by three where two are too common for one task, then by four. Equal suffixes of a
   stretch travel as one row with a weight, and prefixes too common for one task travel as counts.
3. ``quicksort``: a task splits its suffixes three ways by the word at the current depth. The weight of the equal part is
   the count of that prefix, whose suffixes go one word deeper; parts whose weight is below ``least`` are abandoned.

Cases: null texts are empty, a null language is ``und``; texts without words give nothing; very long texts are taken in
stretches cut at piece ends (a piece without any mark is taken whole); repeated rows count each time; equal scores rank by
count, then by the phrase's bytes; an empty table gives an empty result; other columns of the documents are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regista.llm.common import materialize

DEPTH, LEAST, KEPT = 5, 100, 2000
#: Bytes of text taken at a time.
STRETCH = 4 << 20
#: Entries of the table of pairs, and of those of triples and quadruples: what tasks send and receive, at any size of the corpus.
PAIRS, LONGER = 1 << 22, 1 << 18
#: Entries that are summed together.
PART = 1 << 14
#: Suffixes that one group sorts, about; a prefix that may have more is routed by one more word.
ROUTED = 1 << 18
#: Lower case for A-Z, a line end for every mark and line end, a space for a tab.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Numbers of words in the order of their first use: 0 is the end of a piece, 1 an empty word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Words:
    """The words of one stretch of one language: ``at`` holds their numbers in order, 0 between pieces."""

    def __init__(self, lang: str, text: bytes) -> None:
        ids = _Ids({b"\n": 0, b"": 1})
        tokens = text.replace(b"\n", b" \n ").split(b" ")
        at = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
        self.lang, self.at, self.words = lang, at[at != 1], list(ids)
        seed = zlib.crc32(lang.encode())
        self.hash = np.fromiter((zlib.crc32(w, seed) for w in self.words), np.uint64, len(self.words))

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``size`` words from every place, and whether such a run is within its piece."""
        n = max(len(self.at) - size + 1, 0)
        h, inside = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(size):
            at = self.at[k : k + n]
            h = (h ^ self.hash[at]) * _MIX
            h ^= h >> np.uint64(29)
            inside &= at > 0
        return h, inside


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    """Words of (lang, text) rows, by language and stretch."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            text, lo = (text or b"").translate(_FOLD), 0
            while lo < len(text):
                hi = len(text)
                if hi - lo > STRETCH:  # ends with a piece
                    hi = (text.rfind(b"\n", lo, lo + STRETCH) + 1) or (text.find(b"\n", lo + STRETCH) + 1) or len(text)
                held.setdefault(lang, []).append(text[lo:hi])
                size[lang] = size.get(lang, 0) + hi - lo
                if sum(size.values()) > STRETCH:
                    for some in list(held):
                        yield _Words(some, b"\n".join(held.pop(some)))
                    size.clear()
                lo = hi
    for some in held:
        yield _Words(some, b"\n".join(held[some]))


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def survey(rows: DataFrame) -> DataFrame:
    """Stored counts of a pass over (lang, text): (lang, word, n) by stretch, and (part, counts) of the tables by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros(PAIRS + 2 * LONGER, np.int64)
        lo = [0, PAIRS, PAIRS + LONGER, len(tables)]
        for some in _stretches(batches):
            for k, size in enumerate((2, 3, 4)):
                h, inside = some.hashes(size)
                m = lo[k + 1] - lo[k]
                tables[lo[k] : lo[k + 1]] += np.bincount((h[inside] & np.uint64(m - 1)).astype(np.int64), minlength=m)
            n = np.bincount(some.at, minlength=len(some.words))[2:]
            words = pa.array(some.words[2:], pa.binary()).cast(pa.string())
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([some.lang] * len(n), pa.string()), words, pa.array(n), *none], names=["lang", "word", "n", "part", "counts"])
        used = [k for k in range(len(tables) // PART) if tables[k * PART : (k + 1) * PART].any()]
        for k in used:
            counts = pa.array([tables[k * PART : (k + 1) * PART].tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), counts], names=["lang", "word", "n", "part", "counts"])

    return materialize(rows.mapInArrow(run, "lang string, word string, n long, part int, counts binary"), "survey")


def tables(found: DataFrame, least: int, routed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the summed tables, which entries of pairs reach ``least``, which entries of all pass ``routed``, and how many pairs
    are in the former: bit maps of fixed size."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        for part, n in sums.items():
            often = n >= least
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([np.packbits(often).tobytes()], pa.binary()), pa.array([np.packbits(n > routed).tobytes()], pa.binary()), pa.array([int(n[often].sum())])],
                names=["part", "often", "hot", "n"],
            )

    parts = (PAIRS + 2 * LONGER) // PART
    summed = found.where("part is not null").select("part", "counts").repartition("part").mapInArrow(total, "part int, often binary, hot binary, n long")
    often, hot, kept = np.zeros(parts * PART, bool), np.zeros(parts * PART, bool), 0
    for part, a, b, n in summed.collect():
        often[part * PART : (part + 1) * PART] = np.unpackbits(np.frombuffer(a, np.uint8))
        hot[part * PART : (part + 1) * PART] = np.unpackbits(np.frombuffer(b, np.uint8))
        kept += n if part * PART < PAIRS else 0
    return often[:PAIRS], hot, kept


def suffixes(rows: DataFrame, often: np.ndarray, hot: np.ndarray, groups: int) -> DataFrame:
    """Stored (lang, route, depth, phrase, n), the last three as lists: the suffixes of a stretch, up to their first infrequent
    pair, that one group sorts, and the least length that the group counts; without a route, prefixes counted here."""
    often, hot = np.packbits(often), np.packbits(hot)  # as they travel

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, common = np.unpackbits(often).astype(bool), np.unpackbits(hot).astype(bool)
        for some in _stretches(batches):
            size = len(some.at)
            h, inside = some.hashes(2)
            ok = np.zeros(size + DEPTH, bool)
            ok[: len(h)] = inside & frequent[(h & np.uint64(PAIRS - 1)).astype(np.int64)]
            start = np.flatnonzero(ok[:size])
            if not len(start):
                continue
            length, going = np.full(len(start), 2), np.ones(len(start), bool)
            for k in range(1, DEPTH - 1):
                going = going & ok[start + k]
                length += going
            at = np.concatenate([some.at, np.zeros(DEPTH, np.int64)])
            words = [np.where(k < length, at[start + k], 0) for k in range(DEPTH)]
            v = len(some.words)
            keys = [words[k] * v + (words[k + 1] if k + 1 < DEPTH else 0) for k in range(0, DEPTH, 2)]
            order = np.lexsort(keys[::-1])
            new = np.ones(len(order), bool)
            new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
            first = np.flatnonzero(new)
            weight = np.diff(np.append(first, len(order)))
            one = order[first]
            start, length, words = start[one], length[one], [w[one] for w in words]
            # one word more as long as the prefix is too common; prefixes that are go as counts
            depth, route = np.full(len(start), 2), np.zeros(len(start), np.uint64)
            for size, lo, m in ((2, 0, PAIRS), (3, PAIRS, LONGER), (4, PAIRS + LONGER, LONGER)):
                hashed = some.hashes(size)[0]
                here = np.flatnonzero((depth == size) & (length >= size))
                mine = hashed[start[here]]
                route[here] = mine
                depth[here] += common[lo + (mine & np.uint64(m - 1)).astype(np.int64)]
            five = np.flatnonzero((depth == DEPTH) & (length == DEPTH))
            if len(five):
                route[five] = some.hashes(DEPTH)[0][start[five]]
            vocabulary = pa.array(some.words, pa.binary())

            def lists(which: np.ndarray, most: np.ndarray, to: np.ndarray | None) -> pa.RecordBatch:
                """One row of lists for each group that ``which`` go to; without groups, one for all."""
                if to is not None:
                    by = np.argsort(to, kind="stable")
                    which, most, to = which[by], most[by], to[by]
                cut = np.flatnonzero(np.diff(to)) + 1 if to is not None else np.zeros(0, np.int64)
                offsets = pa.array(np.concatenate([[0], cut, [len(which)]]).astype(np.int32))
                parts = [vocabulary.take(pa.array(words[k][which], mask=k >= most)) for k in range(int(most.max()))]
                phrase = pc.binary_join_element_wise(*parts, b" ", null_handling="skip").cast(pa.string())
                columns = [pa.array(depth[which].astype(np.int32)), phrase, pa.array(weight[which])]
                routes = pa.array(to[np.concatenate([[0], cut])]) if to is not None else pa.nulls(1, pa.int64())
                return pa.RecordBatch.from_arrays([pa.array([some.lang] * len(routes), pa.string()), routes, *[pa.ListArray.from_arrays(offsets, c) for c in columns]], names=["lang", "route", "depth", "phrase", "n"])

            sent = np.flatnonzero(depth <= length)
            for lo in range(0, len(sent), 1 << 17):
                part = sent[lo : lo + (1 << 17)]
                yield lists(part, length[part], (route[part] >> np.uint64(20)).astype(np.int64) % groups)
            for size in range(2, DEPTH):
                counted = np.flatnonzero((depth > size) & (length >= size))
                if len(counted):
                    yield lists(counted, np.full(len(counted), size), None)

    return materialize(rows.mapInArrow(run, "lang string, route long, depth array<int>, phrase array<string>, n array<long>"), "suffixes")


def quicksort(codes: list[np.ndarray], weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(a row that starts with it, length, count) of every prefix with a count of ``least`` or more. ``codes[d]`` holds the
    words at depth d, -1 past the end."""
    todo = [(np.arange(len(weight)), 0)]
    while todo:
        some, depth = todo.pop()
        if depth == len(codes) or int(weight[some].sum()) < least:
            continue
        word = codes[depth][some]
        pivot = word[len(word) // 2]
        same = some[word == pivot]
        todo.append((some[word < pivot], depth))
        todo.append((some[word > pivot], depth))
        if pivot >= 0 and (n := int(weight[same].sum())) >= least:
            yield int(same[0]), depth + 1, n
            todo.append((same, depth + 1))


def _counted(key: tuple, table: pa.Table, least: int) -> pa.Table:
    """(lang, phrase, n) of the frequent phrases of one group of suffixes."""
    parts = pc.split_pattern(pc.list_flatten(table.column("phrase").combine_chunks()), " ")
    words = parts.flatten().dictionary_encode()
    code, offsets = words.indices.to_numpy(), parts.offsets.to_numpy()
    length = np.diff(offsets)
    codes = [np.where(k < length, code[np.minimum(offsets[:-1] + k, max(len(code) - 1, 0))], -1) for k in range(DEPTH)]
    depth, weight = (pc.list_flatten(table.column(c).combine_chunks()).to_numpy() for c in ("depth", "n"))
    found = [(row, size, n) for row, size, n in quicksort(codes, weight, least) if size >= depth[row]]
    phrases = [" ".join(words.dictionary[int(codes[k][row])].as_py() for k in range(size)) for row, size, _ in found]
    lang = table.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "phrase": pa.array(phrases, pa.string()), "n": pa.array([n for *_, n in found], pa.int64())})


def phrase_counts(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", routed: int = ROUTED) -> tuple[DataFrame, DataFrame]:
    """Two stored tables (lang, phrase, f): all words, and the phrases of two to ``DEPTH`` words with f of ``least`` or more."""
    rows = _rows(docs, text, lang)
    found = survey(rows)
    often, hot, kept = tables(found, least, routed)
    words = materialize(found.where("word is not null").groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("f")), "words")
    sent = suffixes(rows, often, hot, max(1, math.ceil(kept / routed)))
    sort = lambda key, table: _counted(key, table, least)
    sorted_ = sent.where("route is not null").groupBy("lang", "route").applyInArrow(sort, "lang string, phrase string, n long")
    counts = sorted_.unionByName(sent.where("route is null").select("lang", F.inline(F.arrays_zip("phrase", "n")))).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return words, materialize(counts, "phrases")


def mine(docs: DataFrame, least: int = LEAST, kept: int = KEPT, text: str = "text", lang: str = "lang", routed: int = ROUTED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``kept`` phrases that hold together best.

    A phrase's score is floor(1000 a n / (l r)) at its weakest cut, exact while a n stays below 10^35; ties go to the first
    cut. Phrases inside a longer one that occurs as often are dropped: as counts never grow with length, it is enough to look
    one word further at each end."""
    words, phrases = phrase_counts(docs, least, text, lang, routed)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    split = phrases.withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " ")).withColumn("m", F.size("w"))
    part = lambda lo, size: F.concat_ws(" ", F.slice("w", lo, size))
    inner = split.where("m > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("m") - 1), part(F.lit(2), F.col("m") - 1))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    held = split.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < a")
    cuts = held.select("lang", "phrase", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    every = words.where(F.col("f") >= least).unionByName(phrases)
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(n, "lang")
    score = F.expr("(cast(1000 as decimal(4)) * cast(a as decimal(17)) * cast(n as decimal(17))) div (cast(l as decimal(19)) * cast(r as decimal(19)))")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"), F.first("a").alias("a"), F.first("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = best.select("lang", "phrase", "a", "b.l", "b.r", "n", F.col("b.score").cast("long").alias("score")).withColumn("rank", rank).where(F.col("rank") <= kept)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
