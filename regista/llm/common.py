"""Shared helpers: order-safe keys, Arrow batches, reading."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regista.plans.store import materialize, shared_dir  # noqa: F401

#: Key given to rows whose id is null: they sort before every id, as nulls do.
NULL_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_key(col: str | Column) -> Column:
    """A non-null long for an id column."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("long"), F.lit(NULL_ID))


def doc_key(text: str = "text") -> Column:
    """Fingerprint that tells apart rows that repeat a doc_id with another text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def smallest_hashes(rows: DataFrame, most: int, seed: int, *key: str) -> DataFrame:
    """The ``most`` rows with the smallest hashes of ``key``. Rows whose hash is certainly not among them are dropped in their
    own tasks first, so that about twice ``most`` rows move at any size of the table, not ``most`` from every task."""
    number = rows.count()
    h = F.xxhash64(F.lit(seed), *key)
    if number > 4 * most:
        rows = rows.where(h < F.lit(int(-(2**63) + 2**64 * (2 * most / number))))
    return rows.orderBy(h, *key).limit(most)


def fitting(sizes: list[int], most: int) -> list[bool]:
    """Which of a bounded sample's members to take, in order, so that their sizes add up to at most ``most``: one that does
    not fit is passed over, and smaller ones after it are still taken."""
    out, left = [], most
    for size in sizes:
        out.append(size <= left)
        left -= size if out[-1] else 0
    return out


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column of a batch, nulls as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def with_columns(batch: pa.RecordBatch, **more) -> pa.RecordBatch:
    """``batch`` with further columns (Arrow arrays); a column of the same name is replaced."""
    names = [n for n in batch.schema.names if n not in more]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*arrays, *more.values()], names=[*names, *more])


def stretches(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of about ``most`` characters, with their texts; a longer text is a slice of its own."""
    some, lo = texts(batch), 0
    while lo < len(some):
        hi, total = lo, 0
        while hi < len(some) and (hi == lo or total + len(some[hi]) <= most):
            total += len(some[hi])
            hi += 1
        yield batch.slice(lo, hi - lo), some[lo:hi]
        lo = hi
