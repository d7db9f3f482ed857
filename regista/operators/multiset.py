"""Hashes of multisets of rows that follow changes: adding or removing rows costs as much as these rows, not the whole set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums of the numbers of 32 bits that a row's digest is read as are modulo this.
_MOD = 1 << 32


def lanes(row: Column, bits: int = 512) -> list[Column]:
    """A row's digest as numbers."""
    digest = F.sha2(row, bits)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(bits // 32)]


def totals(rows: DataFrame, group: list[str], row: Column, sign: int = 1, bits: int = 512) -> DataFrame:
    """(group, n, sums) of ``rows``, each counted ``sign`` times: partial sums meet, no list is gathered, in any order."""
    names = [f"_{k}" for k in range(bits // 32)]
    each = rows.select(*group, *[c.alias(n) for n, c in zip(names, lanes(row, bits))])
    sums = each.groupBy(*group).agg(F.count("*").alias("n"), *[F.pmod(F.sum(n) * sign, F.lit(_MOD)).alias(n) for n in names])
    return sums.select(*group, (F.col("n") * sign).alias("n"), F.array(*names).alias("sums"))


def combined(*parts: DataFrame, group: list[str], bits: int = 512) -> DataFrame:
    """(group, n, sums) of the sets put together: what was, what was added, and what was removed (sign -1)."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    names = [f"_{k}" for k in range(bits // 32)]
    out = every.groupBy(*group).agg(F.sum("n").alias("n"), *[F.pmod(F.sum(F.get("sums", F.lit(k))), F.lit(_MOD)).alias(n) for k, n in enumerate(names)])
    return out.select(*group, "n", F.array(*names).alias("sums"))


def digest(sums: str = "sums") -> Column:
    """The hash of a set, from its sums."""
    return F.sha2(F.array_join(F.transform(sums, lambda x: x.cast("string")), ","), 256)
