"""Substring search by trigrams: postings of every three characters of a text, intersected, then verified."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regista.plans.store import freed, shared_dir

#: Folders that the postings are dealt to by trigram: a search reads those of its own trigrams only.
BUCKETS = 64
#: A posting is a list of places in a block of 1 << PLACE_BITS rows (so that a place is a short).
PLACE_BITS = 15
#: Characters whose trigrams are sorted at once.
STRETCH = 1 << 20
#: Characters of all texts for each file of a folder.
FILE_CHARS = 1 << 28


def _stretches(rows: Iterable[int], texts: Iterable[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and texts by stretches. A longer text is cut into parts that share two characters, so that each of its trigrams is
    in one part; a text of fewer than three characters is in none."""
    at, parts, size = [], [], 0
    for row, text in zip(rows, texts):
        for k in range(0, len(text) - 2, STRETCH):
            at.append(row)
            parts.append(text[k : k + STRETCH + 2])
            size += len(parts[-1])
            if size >= STRETCH:
                yield at, parts
                at, parts, size = [], [], 0
    if at:
        yield at, parts


def _listed(at: list[int], parts: list[str]) -> pa.RecordBatch:
    """The postings of a stretch: for each trigram and block the places of the rows that hold it."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    chars = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.int64)
    inside = np.ones(len(chars) - 2, bool)
    between = np.cumsum(lengths)[:-1]
    inside[between - 1] = inside[between - 2] = False  # trigrams over the end of a part
    code = (chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:])[inside]
    order = np.argsort(code, kind="stable")
    code, row = code[order], np.repeat(np.array(at, np.int64), lengths - 2)[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    code, row = code[new], row[new]
    block = row >> PLACE_BITS
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
    starts = np.flatnonzero(new)
    grams, low = code[starts], (1 << 21) - 1
    said = np.stack([grams >> 42, grams >> 21 & low, grams & low], 1).astype("<u4").tobytes().decode("utf-32-le")
    places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array((row & (1 << PLACE_BITS) - 1).astype(np.int16)))
    return pa.RecordBatch.from_arrays([pa.array([said[k : k + 3] for k in range(0, len(said), 3)]), pa.array(block[starts]), places], ["gram", "block", "places"])


def _postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = (t.decode("utf-8", "replace") for t in batch.column(1).to_pylist())
        for at, parts in _stretches(batch.column(0).to_pylist(), texts):
            yield _listed(at, parts)


class SubstringIndex:
    """Rows (key..., text) with their postings in the shared folder. ``search`` gives the keys of the rows whose text holds a
    term, case aside: the same rows as a scan. Rows are numbered as they are stored, so keys may be any columns that a search
    should give, whether they tell rows apart or not. The postings of a trigram are lists of places by blocks of rows, made
    in arrays where the texts are read, so what is shuffled is two bytes for each trigram of a text. A term of n characters
    reads the postings of its n - 2 trigrams, each sorted in its folder, and the rows that hold them all are verified; a term
    of fewer than three characters has none and is scanned for. Null texts are empty."""

    def __init__(self, rows: DataFrame, keys: list[str], text: str, folder: str | None = None) -> None:
        self.spark: SparkSession = rows.sparkSession
        self.keys = keys
        self.folder = folder or f"{shared_dir(self.spark)}/trigrams-{uuid.uuid4().hex}"
        low = F.lower(F.coalesce(F.col(text), F.lit("")))
        with freed(self.spark):
            rows.select(*keys, low.alias("__text"), F.monotonically_increasing_id().alias("__row")).write.option("compression", "zstd").parquet(f"{self.folder}/texts")
            texts = self._texts()
            listed = texts.select("__row", F.col("__text").cast("binary")).mapInArrow(_postings, "gram string, block long, places array<short>")
            listed = listed.withColumn("bucket", F.pmod(F.crc32(F.encode("gram", "UTF-8")), F.lit(BUCKETS)).cast("int"))
            # blocks are dealt to several files of a folder, so that no task holds all of a frequent trigram or of a folder
            files = 1 + (texts.agg(F.sum(F.octet_length("__text"))).first()[0] or 0) // FILE_CHARS
            dealt = listed.repartition("bucket", F.pmod(F.hash("block"), F.lit(files)))
            dealt.sortWithinPartitions("bucket", "gram").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/postings")

    def _texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/texts")

    def postings(self, term: str) -> DataFrame | None:
        """The postings of a term's trigrams, or None for a term that is too short for one."""
        grams = sorted({term[k : k + 3] for k in range(len(term) - 2)})
        if not grams:
            return None
        buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})
        postings = self.spark.read.schema("gram string, block long, places array<short>, bucket int").parquet(f"{self.folder}/postings")
        return postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))

    def search(self, term: str) -> DataFrame:
        """The keys of the rows whose text holds ``term``."""
        term = term.lower()
        found = self.postings(term)
        texts = self._texts().where(F.col("__text").contains(term))
        if found is None:
            return texts.select(*self.keys)
        number = len({term[k : k + 3] for k in range(len(term) - 2)})
        lists = found.groupBy("block", "gram").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
        lists = lists.groupBy("block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == number)
        places = F.aggregate(F.slice("lists", 2, number), F.col("lists")[0], F.array_intersect)
        able = lists.select("block", F.explode(places).alias("place")).select((F.shiftleft("block", PLACE_BITS) + F.col("place")).alias("__row"))
        return texts.join(able, "__row", "left_semi").select(*self.keys)
