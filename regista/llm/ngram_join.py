"""N-gram Jaccard self-join: MinHash LSH forest, then exact verification.

1. A document is the set of its five-word shingles (words: runs of letters, digits and underscores, lower-cased; a text of
   fewer words is one shingle). Documents with equal sets form one class at once and go on as one.
2. Each of ``trees`` trees is a prefix trie of the sets' MinHash paths of ``deepest`` minima, held as sorted binary paths: a
   prefix of bytes is a node. A pair of similarity J shares a node at depth l with probability J^l.
3. Matched prefixes start at full depth and are shortened until the target recall is met twice: as measured, on the exact
   partners of ``sampled`` documents in the whole corpus (mean over those documents), and by the bound for pairs right at
   the threshold. The sample's shingles meet every document in the pass that signs it.
4. The sets of a node are compared by all their minima, which tells pairs near the threshold from chance meetings; only
   links to the least set they hang together with leave a node, never pairs. A node of more than ``NODE`` sets is as good
   as never chance and links to its least set as it is.
5. What hangs together is verified: it is dealt into blocks of bounded size, each pair of blocks is one task that counts exact
   intersections by matrix products over the shared shingles, and only per-document counts and a spanning tree leave it.
   Chance meetings no longer join here, so the work follows the numbers of links that are counted.

Result: one row per document with the class (connected by similarity of at least ``threshold``; the smallest doc_id of
it), n_links (other documents, copies included, at least that similar) and n_shingles.

Cases: null, empty and wordless texts have no shingles, a class of their own and no links; repeated rows are copies of one
another; null ids sort first and have a null class; ties cannot occur; an empty table gives an empty result; further
columns pass through ``keep_one``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regista.llm.common import NULL_ID, doc_key, fitting, id_key, materialize, smallest_hashes, stretches, texts
from regista.operators.graph import components

WORDS = 5
#: Bounds of a verification block (shingles, and documents until there are many), and sets of a node compared at once.
BLOCK_SHINGLES, BLOCK_DOCS, NODE = 1 << 18, 64, 256
#: Characters met at a time.
STRETCH = 4_000_000
_word = re.compile(r"\w+").findall
_M = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return value


_hashes = WordHash()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles."""
    words = _word(text.lower())
    code = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(code))
    if not width:
        return code
    out = np.full(len(code) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed((out + code[i : len(code) - width + 1 + i]) * _M)
    return np.unique(out)


def bound(threshold: float, trees: int, depth: int) -> float:
    """Share of the pairs at the threshold that share a node of this depth in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def minima(some: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The MinHash minima of a set, as big-endian 32-bit numbers, so that paths sort as bytes."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(some), 2048):
        part = some[lo : lo + 2048]
        least = np.minimum(least, (odd[:, None] * (part ^ (part >> np.uint64(32)))[None, :]).min(1))
    return (least >> np.uint64(32)).astype(">u4")


class Sample:
    """Some documents' shingle sets and minima, to be met by every other document."""

    def __init__(self, some: list[str], odd: np.ndarray, n: int, threshold: float) -> None:
        sets = {s.tobytes(): s for s in (shingles(t, n) for t in some) if len(s)}
        self.same, self.threshold = {x: i for i, x in enumerate(sets)}, threshold
        rows = list(sets.values())
        self.size = np.array([len(r) for r in rows], np.int64)
        owner = np.repeat(np.arange(len(rows)), self.size)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, at = np.unique(flat[order], return_index=True)
        self.owner, self.at = owner[order], np.append(at, len(flat))
        self.minima = np.array([minima(r, odd) for r in rows]).reshape(len(rows), len(odd))

    def met(self, some: np.ndarray, own: np.ndarray, deepest: int) -> list[int]:
        """The sample's documents at least as similar as the threshold, each with the depth at which some tree meets:
        16 * number + depth."""
        if not len(self.keys) or not len(some):
            return []
        at = np.minimum(self.keys.searchsorted(some), len(self.keys) - 1)
        at = at[self.keys[at] == some]
        if not len(at):
            return []
        first, number = self.at[at], self.at[at + 1] - self.at[at]
        place = np.repeat(first - np.append(0, np.cumsum(number)[:-1]), number) + np.arange(number.sum())
        both = np.bincount(self.owner[place], minlength=len(self.size))
        both[self.same.get(some.tobytes(), [])] = 0  # copies are no partners
        near = np.flatnonzero((both > 0) & (both >= self.threshold * (self.size + len(some) - both) - 1e-6))
        out = []
        for i in near.tolist():
            equal = (self.minima[i] == own).reshape(-1, deepest)
            out.append(16 * i + int(np.cumprod(equal, 1).sum(1).max()))
        return out


def drawn(docs: DataFrame, sampled: int, longest: int = 4_000_000) -> list[str]:
    """Texts of the ``sampled`` documents with the smallest hashes, of which those that no longer fit into ``longest`` characters
    are passed over."""
    keyed = docs.select(id_key("doc_id").alias("d"), doc_key().alias("k"), F.char_length("text").alias("size")).where("size > 0")
    rows = smallest_hashes(keyed.distinct(), sampled, 29, "d", "k").collect()  # ``sampled`` rows
    fits = fitting([r["size"] for r in rows], longest)
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r.d, r.k) for r, ok in zip(rows, fits, strict=True) if ok], "d long, k long")
    texts_ = docs.select(id_key("doc_id").alias("d"), doc_key().alias("k"), "text").join(F.broadcast(chosen), ["d", "k"])
    return [r.text for r in texts_.groupBy("d", "k").agg(F.first("text").alias("text")).orderBy("d", "k").collect()]


def signatures(docs: DataFrame, trees: int, deepest: int, n: int, sampled: int, threshold: float) -> DataFrame:
    """(d, k, s, n, paths, met): set identity, size and paths of every document, and what it meets of the sample."""
    odd = np.random.default_rng(11).integers(0, 2**63, trees * deepest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sample = docs.sparkSession.sparkContext.broadcast(Sample(drawn(docs, sampled), odd, n, threshold))  # bounded by ``drawn``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, some in stretches(whole, STRETCH):
                sets = [shingles(t, n) for t in some]
                signed = [minima(s, odd) for s in sets]
                cols = [
                    batch.column(0), batch.column(1),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([m.tobytes() for m in signed], pa.binary()),
                    pa.array([sample.value.met(s, m, deepest) for s, m in zip(sets, signed, strict=True)], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["d", "k", "s", "n", "paths", "met"])

    keyed = docs.select(id_key("doc_id").alias("d"), doc_key().alias("k"), "text")
    return keyed.mapInArrow(run, "d long, k long, s binary, n long, paths binary, met array<int>")


def recalls(seen: DataFrame, deepest: int) -> list[float]:
    """Measured recall at depths 1..deepest: of the sampled documents with partners, the mean share of partners met in some
    tree. Empty if none has a partner."""
    met = seen.select(F.explode("met").alias("m")).groupBy(F.floor(F.col("m") / 16).alias("i"), (F.col("m") % 16).alias("depth")).count()
    count = {}
    for r in met.collect():  # ``sampled`` documents times ``deepest`` depths at most
        count.setdefault(r.i, np.zeros(deepest + 1))[r.depth] += r["count"]
    return [float(np.mean([c[depth:].sum() / c.sum() for c in count.values()])) for depth in range(1, deepest + 1)] if count else []


def shortened(measured: list[float], threshold: float, trees: int, deepest: int, recall: float) -> int:
    """The deepest prefix that meets the target."""
    depth = deepest
    while depth > 1 and (bound(threshold, trees, depth) < recall or measured and measured[depth - 1] < recall):
        depth -= 1
    return depth


def hung(nodes: DataFrame, trees: int, deepest: int, threshold: float) -> DataFrame:
    """(src, dst) links of sets of a node (``sets``: array of v and paths) to the least set they hang together with."""
    size = trees * deepest
    # five standard errors below the threshold
    least = size * (threshold - 5 * (threshold * (1 - threshold) / size) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for members in batch.column(0).to_pylist():
                members.sort(key=lambda m: (m["v"]["d"], m["v"]["k"]))
                bits = np.frombuffer(b"".join(m["paths"] for m in members), np.uint8).reshape(len(members), size, 4)[:, :, 3]
                label = np.arange(len(members))
                near = np.array([(bits == row).sum(1) >= least for row in bits])
                while True:
                    new = np.array([label[row].min() for row in near])
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                for i in np.flatnonzero(label != np.arange(len(members))).tolist():
                    src.append(members[i]["v"])
                    dst.append(members[label[i]]["v"])
            kind = pa.struct([("d", pa.int64()), ("k", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(src, kind), pa.array(dst, kind)], names=["src", "dst"])

    return nodes.select("sets").mapInArrow(run, "src struct<d:long,k:long>, dst struct<d:long,k:long>")


def candidates(sets: DataFrame, trees: int, deepest: int, depth: int, threshold: float) -> DataFrame:
    """(src, dst): links between sets (v, paths) that share a node of ``depth``."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    paths = sets.select("v", "paths", tree.alias("tree")).select("v", F.xxhash64("tree", F.substring("paths", F.col("tree") * F.lit(4 * deepest) + 1, F.lit(4 * depth))).alias("node"))
    # the order-free fingerprint of a node's sets tells nodes that hold the same sets, of which one is enough
    one = F.xxhash64("v").cast("decimal(38,0)")
    nodes = paths.groupBy("node").agg(F.min("v").alias("head"), F.count("*").alias("m"), F.sum(one).alias("print")).where("m > 1")
    nodes = nodes.groupBy("head", "m", "print").agg(F.min("node").alias("node"))
    members = materialize(paths.join(materialize(nodes, "nodes").hint("merge"), "node").select("node", "head", "m", "v"), "members")
    large = members.where(F.col("m") > NODE).select(F.col("v").alias("src"), F.col("head").alias("dst")).where("src != dst")
    small = members.where(F.col("m") <= NODE).select("node", "v").join(sets.select("v", "paths").hint("merge"), "v")
    small = small.groupBy("node").agg(F.collect_list(F.struct("v", "paths")).alias("sets"))  # at most NODE sets
    return hung(small, trees, deepest, threshold).unionByName(large).distinct()


def adjacency(rows: list[np.ndarray], size: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets are at least ``threshold`` similar."""
    m = len(rows)
    owner = np.repeat(np.arange(m), [len(r) for r in rows])
    flat = np.concatenate(rows) if m else np.zeros(0, np.uint64)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    rename = np.full(len(count), -1)
    rename[shared] = np.arange(len(shared))
    column = rename[code]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter = np.zeros((m, m), np.float32)
    width = 4096
    for lo in range(0, len(shared), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((m, min(width, len(shared) - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        inter += part @ part.T
    near = np.zeros((m, m), bool)
    for lo in range(0, m, 256):
        part = inter[lo : lo + 256]
        near[lo : lo + 256] = part >= threshold * (size[lo : lo + 256, None] + size[None, :] - part) - 1e-6
    np.fill_diagonal(near, False)
    return near


def verify(members: DataFrame, threshold: float, n: int) -> DataFrame:
    """(d, k, links, root): per task the exact links of each set and the least set it is connected to there.
    ``members``: d, k, comp, copies, n, blocks, block, text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.array([shingles(t, n).tobytes() for t in texts(batch)], pa.binary())
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), data], names=[*keep, "x"])

    cuts = members.select("d", "k", "comp", "copies", "blocks", "block", "text").mapInArrow(cut, "d long, k long, comp struct<d:long,k:long>, copies long, blocks long, block long, x binary")
    # each block meets itself and every other block once
    dealt = cuts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "d", "k", "copies", "block", "x")

    def count(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        d, k, copies, block = get("d"), get("k"), get("copies"), get("block")
        order = np.lexsort((k, d))
        d, k, copies, block = d[order], k[order], copies[order], block[order]
        raw = table.column("x").to_pylist()
        rows = [np.frombuffer(raw[i], np.uint64) for i in order]
        near = adjacency(rows, np.array([len(r) for r in rows], np.float32), threshold)
        if table.column("lo")[0] != table.column("hi")[0]:
            near &= block[:, None] != block[None, :]  # pairs within a block are met elsewhere
        label = np.arange(len(d))
        while True:
            new = np.array([label[near[i]].min(initial=label[i]) for i in range(len(d))])
            new = new[new]
            if (new == label).all():
                break
            label = new
        links = np.array([copies[row].sum() for row in near])
        return pa.table({"d": d, "k": k, "links": links, "root_d": d[label], "root_k": k[label]})

    return dealt.groupBy("comp", "lo", "hi").applyInArrow(count, "d long, k long, links long, root_d long, root_k long")


def classes(docs: DataFrame, threshold: float = 0.8, trees: int = 20, deepest: int = 8, recall: float = 0.999, n: int = WORDS, sampled: int = 256) -> DataFrame:
    """(d, k, n, links, root): every row of ``docs`` (by id and text keys) with its class's least document and its links."""
    seen = materialize(signatures(docs, trees, deepest, n, sampled, threshold), "signatures")
    depth = shortened(recalls(seen, deepest), threshold, trees, deepest, recall)
    sets = seen.where("n > 0").groupBy("s").agg(F.min(F.struct("d", "k")).alias("v"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("paths").alias("paths"))
    sets = materialize(sets, "sets")
    comps = materialize(components(candidates(sets, trees, deepest, depth, threshold)), "candidates")

    sized = comps.join(sets.select(F.col("v").alias("node"), "copies", "n"), "node")
    # blocks of BLOCK_DOCS sets; of more, up to eight times as many, once that gives enough tasks
    number = F.greatest(F.least(F.ceil(F.count("*") / BLOCK_DOCS), F.greatest(F.lit(32), F.ceil(F.count("*") / (8 * BLOCK_DOCS)))), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    mass = sized.groupBy("root").agg(number.cast("long").alias("blocks"))
    members = sized.join(materialize(mass, "mass"), "root").select(
        F.col("node.d").alias("d"), F.col("node.k").alias("k"), F.col("root").alias("comp"), "copies", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    )
    members = materialize(members, "members")
    # merged whatever its size: a broadcast of the candidates would grow with the corpus
    read = docs.select(id_key("doc_id").alias("d"), doc_key().alias("k"), "text").join(members.hint("merge"), ["d", "k"]).dropDuplicates(["d", "k"])
    counted = materialize(verify(read, threshold, n), "verified")

    found = components(counted.select(F.struct("d", "k").alias("src"), F.struct(F.col("root_d").alias("d"), F.col("root_k").alias("k")).alias("dst")))
    linked = counted.groupBy(F.struct("d", "k").alias("node")).agg(F.sum("links").alias("links")).join(found, "node")
    known = sets.join(linked, F.col("v") == F.col("node"), "left").where("copies > 1 OR links > 0")
    known = known.select("s", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "v").alias("root"))
    out = seen.select("d", "k", "s", "n").join(materialize(known, "classes"), "s", "left")
    return out.select("d", "k", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", F.struct("d", "k")).alias("root"))


def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links, n_shingles of every document."""
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return classes(docs, **options).select(null("d").alias("doc_id"), null("root.d").alias("class_id"), F.col("links").alias("n_links"), F.col("n").alias("n_shingles"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, the least; of rows repeated whole one stays as well."""
    found = classes(docs, **options)
    gone = materialize(found.where(F.col("root") != F.struct("d", "k")).select(F.col("d").alias("__d"), F.col("k").alias("__k")).distinct(), "gone")
    keyed = docs.withColumn("__d", id_key("doc_id")).withColumn("__k", doc_key())
    kept = keyed.join(gone.hint("merge"), ["__d", "__k"], "left_anti")
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\w")
    # copies that share even the id have one key; texts without words are nobody's copies
    return kept.where(worded).dropDuplicates(["__d", "__k"]).unionByName(kept.where(~worded)).select(*[f"`{c}`" for c in docs.columns])
