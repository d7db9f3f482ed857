"""Windows and calls over the segments of a source, by tokens, in a number of passes that grows with the logarithm of a
source's length.

Every segment gets the tokens before it in its source. Where a span that starts at a segment ends, and where the next one
starts, are then the last segments whose tokens lie below a bound: frames over the order of these sums. The sums are cut in
blocks of several targets, and a block sees the next one as well, so a source of any length is spread over tasks. Each
segment so points to the start of the next span, and the starts that are reached from the first segment are marked by
doubling the pointers: after k rounds all among the first 2^k spans are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regista.operators.ranking import placed, running
from regista.plans.store import materialize

#: Targets that a block of a source spans.
TARGETS = 64


def _placed(rows: DataFrame) -> DataFrame:
    """(source_id, seq, n) with ``i``, its place from 0, and ``p``, the tokens before it; seq tells a source's rows apart."""
    return running(placed(rows.select("source_id", "seq", "n"), ["source_id"], [F.col("seq")], "i").withColumn("i", F.col("i").cast("long") - 1), ["source_id"], "i", "n", "p")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Each row in its block, and for the block before as one that is only looked at."""
    at = F.floor(F.col("p") / size)
    return rows.withColumn("block", F.explode(F.array(at, at - 1))).where("block >= 0").withColumn("own", F.col("block") == at)


def reached(pointers: DataFrame) -> DataFrame:
    """(source_id, i) of the places reached from place 0 by following ``next`` of (source_id, i, next), null at the end."""
    jump = materialize(pointers.where("next is not null").select("source_id", "i", "next"), "jump")
    found = materialize(pointers.where("i = 0").select("source_id", "i"), "reached")
    while not jump.isEmpty():
        more = found.join(jump, ["source_id", "i"]).select("source_id", F.col("next").alias("i"))
        new = materialize(found.unionByName(more), "reached")
        if new.count() == found.count():
            break
        found = new
        ahead = jump.select("source_id", F.col("i").alias("next"), F.col("next").alias("then"))
        jump = materialize(jump.join(ahead, ["source_id", "next"]).select("source_id", "i", F.col("then").alias("next")), "jump")
    return found


def _spans(placed_rows: DataFrame, ends: DataFrame) -> DataFrame:
    """source_id, span (from 0), first_seq, last_seq, n_tokens of the spans that are reached. ``ends``: source_id, i, last
    (place of the last segment of a span from i), next."""
    starts = reached(ends).join(ends, ["source_id", "i"])
    last = placed_rows.select("source_id", F.col("i").alias("last"), F.col("seq").alias("last_seq"), (F.col("p") + F.col("n")).alias("upto"))
    first = placed_rows.select("source_id", "i", F.col("seq").alias("first_seq"), "p")
    spans = starts.join(last, ["source_id", "last"]).join(first, ["source_id", "i"])
    return placed(spans, ["source_id"], [F.col("i")], "k").select("source_id", (F.col("k") - 1).alias("span"), "first_seq", "last_seq", (F.col("upto") - F.col("p")).alias("n_tokens"))


def windows(rows: DataFrame, target: int, overlap: int, targets: int = TARGETS) -> DataFrame:
    """source_id, window_seq (from 0), first_seq, last_seq, n_tokens over (source_id, seq, n), n >= 0. A window takes segments
    while it has fewer than ``target`` tokens, so the last may pass it; the next one steps back over whole segments until
    they hold ``overlap`` tokens, and starts one segment further at least. The last window ends with the source."""
    rows = materialize(_placed(rows), "placed")
    size = targets * max(target, overlap)
    by = W.partitionBy("source_id", "block")
    # the first segment of a window that ends with this one: the last that leaves the overlap behind it. Sums up to a segment's end
    # are those before the next one, so a look below the bound gives the segment before
    upto = F.col("p") + F.col("n")
    back = F.max("i").over(by.orderBy("upto").rangeBetween(W.unboundedPreceding, -overlap)) + 1
    seen = _blocks(rows, size).withColumn("upto", upto).withColumn("back", F.coalesce(back, F.lit(0)))
    ahead = by.orderBy("p").rangeBetween(W.unboundedPreceding, target - 1)
    seen = seen.withColumn("last", F.max("i").over(ahead)).withColumn("next", F.greatest(F.col("i") + 1, F.max("back").over(ahead))).where("own")
    count = rows.groupBy("source_id").agg(F.max("i").alias("end"))
    ends = seen.join(count, "source_id").select("source_id", "i", "last", F.when(F.col("last") < F.col("end"), F.col("next")).alias("next"))
    return _spans(rows, materialize(ends, "ends")).withColumnRenamed("span", "window_seq")


def calls(rows: DataFrame, most: int, targets: int = TARGETS) -> DataFrame:
    """source_id, call_no (from 0), first_seq, last_seq, n_tokens: consecutive rows of (source_id, seq, n) packed into calls of
    at most ``most`` tokens; a row larger than that is a call of its own."""
    rows = materialize(_placed(rows), "placed")
    by = W.partitionBy("source_id", "block").orderBy("upto").rangeBetween(W.unboundedPreceding, W.currentRow)
    # the last row whose end is within the call: a look up to p + most among the ends, both sorted as one sequence
    ends = _blocks(rows, targets * most)
    marks = ends.select("source_id", "block", F.col("i"), (F.col("p") + F.col("n")).alias("upto"), F.col("i").alias("end"), F.lit(False).alias("asks"))
    asks = ends.where("own").select("source_id", "block", F.col("i"), (F.col("p") + most).alias("upto"), F.lit(None).cast("long").alias("end"), F.lit(True).alias("asks"))
    found = marks.unionByName(asks).withColumn("last", F.max("end").over(by)).where("asks")
    count = rows.groupBy("source_id").agg(F.max("i").alias("n_last"))
    last = F.greatest(F.col("i"), F.coalesce("last", F.lit(-1)))
    found = found.withColumn("last", last).join(count, "source_id").select("source_id", "i", "last", F.when(F.col("last") < F.col("n_last"), F.col("last") + 1).alias("next"))
    return _spans(rows, materialize(found, "ends")).withColumnRenamed("span", "call_no")
