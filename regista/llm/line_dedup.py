"""Line dedup: maximal repeated line runs by distributed prefix doubling over line-ID sequences. DataFrame functions only.

Every non-blank line is a symbol (its 128-bit hash), every document a sequence of symbols, every place in one a suffix.

1. Prefix doubling names the suffixes' prefixes: the name of a run of 2n lines is made of the names of its two halves, so
   each doubling takes one self-join and one aggregation. A name is the first place (doc_id, then place in the document)
   where its run occurs. Suffixes with one name are an interval of the suffix array whose common prefix is at least that
   long; its least place, which the name is, stands for the rank: equality and the first copy are all that is asked of
   it, so no global sort is needed. Only intervals of two suffixes or more stay, and doubling goes on until none is left,
   however long the repetition.
2. A later copy is paired with the first copy of its longest named prefix. Of pairs that continue one another (both places
   moved by one line) only the first, left-maximal one is kept; its longest common prefix is found by going down the
   doubled lengths: where both suffixes have one name at the end of what is known, that length is added.
3. These maximal repeated runs of at least ``min_lines`` lines are deleted from the later copy; the first copy stays. With
   ``min_words``, shorter runs count too if they hold that many words, so that a long passage on one line is found.

Cases: a null text has no lines and stays null; blank lines (only white space) are no symbols and always stay; rows of one
doc_id with different texts are ordered by the text's hash, and rows repeated whole count as one document, so that all of
them get its result; null ids sort first; runs never cross documents; a document may lose all lines and keeps its row;
an empty table gives an empty result; further columns pass through ``strip_runs``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regista.llm.common import doc_key, id_key, materialize

NON_BLANK = r"[^\x20\x09-\x0D]"
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
#: A run of characters between white space; in scripts without spaces, each character.
WORD = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"
DOC = ["d", "k"]


def symbols(docs: DataFrame) -> DataFrame:
    """(d, k, pos, line_no, h, g, words, last): the non-blank lines of every document, numbered, with their 128-bit hash
    and number of words (of the run, and of its last line: here both one line)."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    some = F.filter(lines, lambda s: s["line"].rlike(NON_BLANK))
    rows = docs.where("text IS NOT NULL").select(id_key("doc_id").alias("d"), doc_key().alias("k"), F.posexplode(some).alias("pos", "s"))
    line = F.col("s.line")
    # most lines are ASCII with single spaces between words, which are counted without an expression
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c")
    plain = (F.octet_length(line) == F.char_length(line)) & ~odd
    spaces = F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit("")))
    words = F.when(plain, spaces + 1).otherwise(F.regexp_count(line, F.lit(WORD)))
    return rows.select(*DOC, "pos", F.col("s.line_no").alias("line_no"), F.xxhash64("s.line").alias("h"), F.xxhash64(F.lit(1), "s.line").alias("g"), words.alias("words"), words.alias("last"))


def named(rows: DataFrame, *content: str) -> DataFrame:
    """(d, k, pos, name, and further columns) of the rows whose content occurs at least twice; ``name`` is its first place. The aggregation
    combines before its shuffle, and the join back splits frequent contents, so no content gathers in one task. A place
    has one row in ``rows``."""
    first = rows.groupBy(*content).agg(F.min(F.struct(*DOC, "pos")).alias("name"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = [c for c in rows.columns if c in ("words", "last")]
    again = rows.join(materialize(first, "names").hint("merge"), list(content)).select(*DOC, "pos", "name", *own)
    return materialize(again, "runs")


def following(runs: DataFrame, shift: int) -> DataFrame:
    """(d, k, pos, a, b): names at pos and at pos + shift; with counts, for a shift of one line, those of both together. One
    shuffle by document, whose lines are those of one text."""
    own = [c for c in runs.columns if c == "words"]
    there = Window.partitionBy(*DOC).orderBy("pos").rangeBetween(shift, shift)
    both = runs.select(*DOC, "pos", F.col("name").alias("a"), *own, F.first("name").over(there).alias("b"), *[F.first("last").over(there).alias("last") for _ in own])
    both = both.where("b IS NOT NULL")
    return both.withColumn("words", F.col("words") + F.col("last")) if own else both


def levels(lines: DataFrame, min_lines: int, min_words: int | None) -> list[tuple[int, DataFrame]]:
    """(length, named runs of that length), from single lines over ``min_lines`` lines to the end of all repetition."""
    runs, span = named(lines, "h", "g"), 1
    # rows repeated whole give a place more than once; places stay single from here on
    runs = materialize(runs.dropDuplicates([*DOC, "pos"]), "places")
    out = [(span, runs)]
    while span < min_lines:
        shift = 1 if min_words else min(span, min_lines - span)
        runs = named(following(runs, shift), "a", "b")
        span += shift
        out.append((span, runs))
    while not runs.isEmpty():
        runs = named(following(runs.select(*DOC, "pos", "name"), span), "a", "b")
        span *= 2
        out.append((span, runs))
    return out


def copies(runs: DataFrame, n: int) -> DataFrame:
    """(d, k, pos, source, n): starts of runs of ``n`` lines that also occur earlier, and where first."""
    return runs.where(F.struct(*DOC, "pos") != F.col("name")).select(*DOC, "pos", F.col("name").alias("source"), F.lit(n).alias("n"))


def left_maximal(pairs: DataFrame) -> DataFrame:
    """The pairs that no pair one line further left continues into."""
    place = Window.partitionBy(*DOC).orderBy("pos")  # the lines of one document
    before = F.lag(F.struct("pos", "source")).over(place)
    was = before["source"]
    same = (before["pos"] == F.col("pos") - 1) & (was["d"] == F.col("source.d")) & (was["k"] == F.col("source.k")) & (was["pos"] == F.col("source.pos") - 1)
    return pairs.withColumn("same", F.coalesce(same, F.lit(False))).where("NOT same").drop("same")


def extended(pairs: DataFrame, named_runs: list[tuple[int, DataFrame]]) -> DataFrame:
    """Pairs with ``n`` grown to their longest common prefix; ``n`` is the longest named length at which they agree."""
    names = pairs.columns
    for span, runs in sorted(named_runs, key=lambda x: -x[0]):
        end = (F.col("pos") + F.col("n")).alias("at"), (F.col("source.pos") + F.col("n")).alias("source_at")
        open_ = pairs.withColumn("top", F.col("n")) if "top" not in pairs.columns else pairs
        own = runs.select(F.col("d"), F.col("k"), F.col("pos").alias("at"), F.col("name").alias("a"))
        other = runs.select(F.col("d").alias("sd"), F.col("k").alias("sk"), F.col("pos").alias("source_at"), F.col("name").alias("b"))
        met = open_.select("*", *end, F.col("source.d").alias("sd"), F.col("source.k").alias("sk")).join(own, [*DOC, "at"], "left").join(other, ["sd", "sk", "source_at"], "left")
        longer = F.coalesce((F.col("a") == F.col("b")) & (F.col("top") > span), F.lit(False))
        pairs = met.select(*DOC, "pos", "source", (F.col("n") + F.when(longer, F.lit(span)).otherwise(F.lit(0))).alias("n"), "top")
    return pairs.select(*names)


def maximal_runs(lines: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """(d, k, pos, source, n): runs of n lines from pos on that occur earlier, from ``source`` on. Every line of a run that
    occurs earlier, of ``min_lines`` lines or ``min_words`` words, is in one of them."""
    named_runs = levels(lines, min_lines, min_words)
    found = [copies(runs, n) for n, runs in named_runs if n >= min_lines]
    longest = reduce(DataFrame.unionByName, found).groupBy(*DOC, "pos").agg(F.max_by("source", "n").alias("source"), F.max("n").alias("n"))
    pairs = materialize(left_maximal(longest), "pairs")
    out = [extended(pairs, [x for x in named_runs if x[0] < named_runs[-1][0]])]
    if min_words:
        out += [copies(runs.where(F.col("words") >= min_words), n) for n, runs in named_runs if n < min_lines]
    return materialize(reduce(DataFrame.unionByName, out), "maximal")


def later_copies(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """(d, k, pos, line_no) of the lines inside runs of ``min_lines`` lines or more, or ``min_words`` words if given,
    that also occur earlier."""
    lines = symbols(docs)
    lines = materialize(lines if min_words else lines.drop("words", "last"), "lines")
    runs = maximal_runs(lines, min_lines, min_words)
    covered = runs.select(*DOC, F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("pos")).distinct()
    return lines.select(*DOC, "pos", "line_no").join(covered, [*DOC, "pos"]).distinct()


def removals(gone: DataFrame) -> DataFrame:
    """Per document: spans of removed line numbers in order, how many lines, and how many maximal runs."""
    place = Window.partitionBy(*DOC).orderBy("pos")  # the lines of one document
    marked = gone.withColumn("rank", F.row_number().over(place)).withColumn("run", F.col("pos") - F.col("rank")).withColumn("span", F.col("line_no") - F.col("rank"))
    spans = marked.groupBy(*DOC, "run", "span").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count("*").alias("n"))
    return spans.groupBy(*DOC).agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"), F.sum("n").alias("n_removed"), F.countDistinct("run").alias("n_runs")
    )


def strip_runs(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """``docs`` without later copies of repeated line runs: its columns, and n_lines, n_removed, n_runs."""
    gone = materialize(removals(later_copies(docs, min_lines, min_words)), "gone")
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), id_key("doc_id").alias("d"), doc_key().alias("k"))
    # merged whatever its size: a broadcast of the removals would grow with the corpus
    joined = keyed.join(gone.hint("merge"), DOC, "left").withColumn("lines", F.split("row.text", "\n"))
    # what stands before each span, between two, and after the last
    begin = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get("spans", j - 1)["last"] + 1)
    end = lambda j: F.coalesce(F.get("spans", j)["first"], F.size("lines"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("spans")), lambda j: F.slice("lines", begin(j) + 1, end(j) - begin(j))))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in own],
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"),
    )
