"""Byte-level BPE with a hierarchical-bitmap rank queue.

The bytes of pre-tokens form doubly linked lists of parts. Every adjacent pair that is a vocabulary entry waits in the bucket
of its merge rank; a three-level bitmap over the ranks answers "lowest non-empty bucket" by find-first-set. A position
whose pair has changed since it was put there is stale and skipped. Work is O(n log n) even for one pre-token of
megabytes, where the usual rescan is quadratic.

All new pre-tokens of a stretch of texts share one queue: their lists never touch, so the positions of a bucket can be merged
together, as arrays. Within one pre-token that is the same as one by one from the left unless a merge brings up a pair of
a lower rank, which would have to go first; such pre-tokens merge only their leftmost position in that step.

Cases: null text encodes as the empty text (0 tokens); ids decode to exactly the text's UTF-8 bytes; a row is handled on
its own, so ties, repeated rows and clashing names of further columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from regista.llm.common import stretches

#: Pre-tokens a worker remembers, and characters it handles at a time; they cost or save time but never change a result.
REMEMBERED, STRETCH = 300_000, 6_000_000


class RankQueue:
    """Buckets of positions by merge rank under a three-level bitmap."""

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[np.ndarray] | None] = [None] * ranks
        self.leaf, self.mid, self.top = [0] * ((ranks >> 6) + 1), [0] * ((ranks >> 12) + 1), 0

    def put(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets[rank]
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        self.leaf[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def put_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            if len(edges):
                bounds = [0, *edges.tolist(), len(ranks)]
                for rank, lo, hi in zip(ranks[bounds[:-1]].tolist(), bounds, bounds[1:], strict=False):
                    self.put(rank, positions[lo:hi])
                return
        if len(ranks):
            self.put(int(ranks[0]), positions)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and the positions of its bucket, in order and each once."""
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1  # find first set, level by level
        middle = high << 6 | (self.mid[high] & -self.mid[high]).bit_length() - 1
        word = self.leaf[middle]
        rank = middle << 6 | (word & -word).bit_length() - 1
        self.leaf[middle] = word & (word - 1)
        if not self.leaf[middle]:
            self.mid[high] &= ~(1 << (middle & 63))
            if not self.mid[high]:
                self.top &= ~(1 << high)
        bucket, self.buckets[rank] = self.buckets[rank], None
        return rank, bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))


class Merger:
    """Merges pre-tokens over a vocabulary of byte strings and their ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        self.border = self.size  # stands between pre-tokens and pairs with nothing
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs) or [-1], np.int64)
        self.found = np.array([pairs[k] for k in sorted(pairs)] or [-1], np.int64)
        self.byte = np.array([ranks.get(bytes([b]), self.border) for b in range(256)], np.int64)
        self.queue = RankQueue(self.size)

    def rank(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        """Merge ranks of pairs of parts, -1 where they don't merge."""
        key = a << 32 | b
        at = self.keys.searchsorted(key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.found[at], -1)

    def around(self, rank: int, at: np.ndarray, right: np.ndarray, part: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """For pairs (at, right) that merge from the left on: where each ends, the part before it, whether the next one
        begins at its end, and the ranks of its pairs with what stands to the right and to the left as it merges."""
        end, left = after[right], before[at]
        beside = end[:-1] == at[1:]
        left[1:][beside] = at[:-1][beside]
        next_to = part[left]
        next_to[1:][beside] = rank
        return end, left, beside, self.rank(rank, part[end]), self.rank(next_to, rank)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each piece)."""
        queue = self.queue
        data = np.frombuffer(b"\0".join([b"", *pieces, b""]), np.uint8)
        borders = np.cumsum([0, *(len(p) + 1 for p in pieces)])
        part = self.byte[data]
        part[borders] = self.border
        n = len(part)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        pair = np.full(n, -1)
        pair[:-1] = self.rank(part[:-1], part[1:])
        at = np.flatnonzero(pair >= 0)
        queue.put_all(pair[at], at)
        while (got := queue.pop()) is not None:
            rank, at = got
            at = at[pair[at] == rank]  # without stale positions
            if not len(at):
                continue
            right, waiting = after[at], at
            if len(at) > 1:
                chained = right[:-1] == at[1:]
                if chained.any():  # overlapping pairs: every other one from the left
                    place = np.arange(len(at))
                    begin = np.maximum.accumulate(np.where(np.append(True, ~chained), place, 0))
                    keep = (place - begin) % 2 == 0
                    at, right = at[keep], right[keep]
            end, left, beside, to_right, to_left = self.around(rank, at, right, part, after, before)
            early = ((to_right >= 0) & (to_right < rank)) | ((to_left >= 0) & (to_left < rank))
            if early.any():  # a lower pair comes up: of those pre-tokens only the leftmost pair merges now
                owner = borders.searchsorted(at)
                now = ~np.isin(owner, owner[early]) | np.append(True, owner[1:] != owner[:-1])
                if not now.all():
                    queue.put(rank, waiting)  # those that merge now are stale there
                    at, right = at[now], right[now]
                    end, left, beside, to_right, to_left = self.around(rank, at, right, part, after, before)
            to_right[:-1][beside] = to_left[1:][beside]
            part[at], after[at], before[end], alive[right] = rank, end, at, False
            pair[right] = -1
            pair[at], pair[left] = to_right, to_left
            ranks, where = np.concatenate([to_right, to_left]), np.concatenate([at, left])
            fresh = ranks >= 0
            queue.put_all(ranks[fresh], where[fresh])
        alive[borders] = False
        total = np.append(0, np.cumsum(alive))[borders]
        return part[alive], np.diff(total)


class Numbers(dict):
    """Numbers of strings in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        value = self[key] = len(self)
        return value


class Codec:
    """Encoder and decoder over a rank file (token bytes in base 64 and its rank on each line)."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.merger = Merger(self.ranks)
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.csv: list[str] = []
        self.raw: list[bytes] = []
        self.count = np.zeros(0, np.int64)

    def learn(self) -> None:
        """Encode the pre-tokens numbered since the last time: vocabulary entries outright, the others through the queue."""
        pieces = list(islice(self.number, len(self.csv), None))
        raw = [p.encode() for p in pieces]
        whole = [self.ranks.get(r) for r in raw]
        ids, count = self.merger.merge([r for r, w in zip(raw, whole, strict=True) if w is None])
        ids, at = ids.tolist(), [0, *np.cumsum(count).tolist()]
        counts, k = np.ones(len(raw), np.int64), 0
        for i, w in enumerate(whole):
            some = [w]
            if w is None:
                some = ids[at[k] : at[k + 1]]
                counts[i] = len(some)
                k += 1
            self.csv.append(",".join(map(str, some)))
            self.raw.append(self.decode(some))
        self.count = np.append(self.count, counts)

    def coded(self, some: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """(ids joined by commas, number of ids, decoded bytes) of each text."""
        if len(self.number) > REMEMBERED:
            self.forget()
        number, split = self.number.__getitem__, self.split
        numbered = [list(map(number, split(text))) for text in some]
        self.learn()
        csv, raw = self.csv.__getitem__, self.raw.__getitem__
        for at in numbered:
            yield ",".join(map(csv, at)), int(self.count[at].sum()), b"".join(map(raw, at))

    def encode(self, text: str) -> list[int]:
        ids = next(self.coded([text]))[0]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; with ``ids`` also the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, pattern)
        for whole in batches:
            for batch, some in stretches(whole, STRETCH):
                number, hashed, decoded, lists = [], [], [], []
                for csv, count, raw in code.coded(some):
                    number.append(count)
                    hashed.append(hashlib.sha256(csv.encode()).hexdigest())
                    decoded.append(hashlib.sha256(raw).hexdigest())
                    if ids:
                        lists.append([int(x) for x in csv.split(",")] if csv else [])
                cols = [batch.column(0), pa.array(number, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(lists, pa.list_(pa.int64()))] * ids, names=names + ["ids"] * ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, schema)
