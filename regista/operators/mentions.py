"""Whole-word mentions of many names in many texts, by equal runs of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regista.plans.store import materialize


def words(text: str | Column) -> Column:
    """The words of a text in order: letters and digits of any script, lower case."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def mentions(rows: DataFrame, names: DataFrame, group: str = "project_id") -> DataFrame:
    """(group, row_id, name) of the names, from (group, name), that occur in the words of a row, from (group, row_id, words).

    A name is mentioned where its words stand in a row one after another. Names are counted by their number of words, and for
    each number the runs of so many words of a row meet the names by hash; what meets is then compared word by word. A run
    travels only if it starts with a word that starts a name of the group. Each place of a row takes along as many words as the
    longest name has, not the row, so work follows the number of words. Names without a word are never mentioned."""
    parts = names.select(group, "name", words("name").alias("parts")).where(F.size("parts") > 0).withColumn("size", F.size("parts"))
    parts = materialize(parts.distinct(), "names")
    sizes = [r["size"] for r in parts.select("size").distinct().orderBy("size").collect()]  # as many as there are lengths of names
    starts = parts.select(group, F.col("parts")[0].alias("first")).distinct()
    ahead = F.transform(F.sequence(F.lit(1), F.size("words")), lambda at: F.slice("words", at, F.lit(max(sizes, default=1))))
    placed = rows.where(F.size("words") > 0).select(group, "row_id", F.explode(ahead).alias("ahead")).withColumn("first", F.col("ahead")[0]).join(starts, [group, "first"])
    runs = F.array(*[F.when(F.size("ahead") >= n, F.slice("ahead", 1, n)) for n in sizes]) if sizes else F.array().cast("array<array<string>>")
    met = placed.select(group, "row_id", F.explode(F.filter(runs, lambda r: r.isNotNull())).alias("run")).withColumn("hash", F.xxhash64("run")).distinct()
    return met.join(parts.withColumn("hash", F.xxhash64("parts")), [group, "hash"]).where("run = parts").select(group, "row_id", "name").distinct()


def stars(found: DataFrame, least: int, most: DataFrame, group: str = "project_id") -> DataFrame:
    """(group, name, left_id, right_id): rows that mention a name linked to the first of them, for names with ``least`` mentions
    or more and no more than the group's ``most`` (group, most)."""
    count = found.groupBy(group, "name").agg(F.count("*").alias("n"), F.min("row_id").alias("left_id")).join(most, group).where((F.col("n") >= least) & (F.col("n") <= F.col("most")))
    return found.join(count.select(group, "name", "left_id"), [group, "name"]).where("row_id <> left_id").select(group, "name", "left_id", F.col("row_id").alias("right_id"))
