import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from regista.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  two  spaces ", "a\n\nb \n c", "don't I'll", "naïve café — 12345", "日本語テキスト", "x" * 3000, "ab" * 2000, "\x00\x01", "<|endoftext|>", "tab\tand\r\nline", "😀 emoji😀", "a b c"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_the_library(library):
    code = bpe.codec(RANKS, public_tokenizers.PATTERN)
    draw = random.Random(3)
    texts = ODD + ["".join(draw.choice("abcdeé \n,.019日") for _ in range(draw.randrange(60))) for _ in range(400)]
    for text in texts:
        ids = library.encode_ordinary(text)
        assert code.encode(text) == ids
        assert code.decode(ids) == text.encode()
    together = list(code.coded(texts))
    assert together == [(",".join(map(str, ids)), len(ids), text.encode()) for text, ids in ((t, library.encode_ordinary(t)) for t in texts)]


def one_by_one(piece, ranks):
    """The definition: the lowest-ranked pair, the leftmost among equals, until none is left."""
    parts = [bytes([b]) for b in piece]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[x] for x in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_merges_in_any_vocabulary(seed):
    """Ranks in random order, so that merges bring up lower ranks than their own all the time."""
    draw = random.Random(seed)
    words = {"".join(draw.choices("aab", k=draw.randrange(2, 7))).encode() for _ in range(40)} | {b"a", b"b", b"c"}
    ranks = {w: i for i, w in enumerate(draw.sample(sorted(words), len(words)))}
    merger = bpe.Merger(ranks)
    pieces = ["".join(draw.choices("aaabbc", k=draw.randrange(1, 40))).encode() for _ in range(150)] + [b"a" * n for n in range(1, 30)]
    ids, count = merger.merge(pieces)
    at = np.cumsum([0, *count])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [one_by_one(p, ranks) for p in pieces]
    assert merger.queue.pop() is None and not any(merger.queue.leaf) and not any(merger.queue.mid) and all(b is None for b in merger.queue.buckets)


def test_long_pre_tokens(library):
    code = bpe.codec(RANKS, public_tokenizers.PATTERN)
    assert code.encode("abcde" * 4000) == library.encode_ordinary("abcde" * 4000)
    for text in ("a" * 2_000_000, "abracadabra" * 200_000):
        assert code.decode(code.encode(text)) == text.encode()


def test_little_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    code = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in ODD * 2:
        assert code.encode(text) == library.encode_ordinary(text)


def test_encode_decode_rows(spark, library):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, None, None), (2, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == 4
    for row in got:
        text = "hello world" if row.doc_id == 1 else ""
        ids = library.encode_ordinary(text)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encode_decode(docs.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_fast_tokens_equal_the_tokenizer():
    plain = Tokenizer.from_file(JSON)
    mine = packing.Tokens(JSON)
    assert mine.fast is not None and plain.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    texts = ODD + ["".join(random.Random(i).choices("abcé \n,.019日", k=40)) for i in range(200)]
    texts += ["x<|endoftext|>", " <|endoftext|><|endoftext|> y", "<|endoftext|", "a <|endoftext|> b", "<|endoftext|>\n\n<|endoftext|>s"]
    slow = packing.Tokens(JSON)
    slow.fast = None
    for text in texts:
        assert np.frombuffer(mine.one(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert slow.one(text) == mine.one(text)


def test_only_plain_vocabularies_run_as_ranks():
    import json

    spec = json.load(open(JSON, encoding="utf-8"))
    assert packing.byte_ranks(spec) is not None
    first, second, *rest = spec["model"]["merges"]
    assert packing.byte_ranks(spec | {"model": spec["model"] | {"merges": [second, first, *rest]}}) is None
    assert packing.byte_ranks(spec | {"normalizer": {"type": "NFC"}}) is None
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5}
    assert packing.apart(ranks, [b"ab", b"bc", b"abc"], [1, 1, 2])
    assert not packing.apart(ranks, [b"ab", b"bc", b"abc"], [1, 1, 1])  # listed as a + bc, but ab merges first


def check_packing(rows, size):
    by_sequence = {}
    for row in rows:
        by_sequence.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_packing_rows(spark):
    draw = random.Random(1)
    rows = [(i, "word " * draw.choice([0, 1, 5, 40, 300, 900, 3000]), "z") for i in range(120)] + [(7, "word", "dup"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(docs, JSON, ids=True).collect()
    used = check_packing(got, 2048)
    assert used <= -(-sum(r.length for r in got) // 2048) + 2
    plain = Tokenizer.from_file(JSON)
    whole = sorted(tuple(plain.encode(t or "", add_special_tokens=False).ids + [0]) for _, t, _ in rows)
    assert sum(r.length for r in got) == sum(map(len, whole))
    for row in got:
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes()) and len(row.ids) == row.length
        assert row.length == 2048 or row.piece == 0
    assert packing.pack_documents(docs.where("false"), JSON).count() == 0


@pytest.mark.parametrize("counts", [{}, {2048: 5}, {1: 3}, {1024: 7, 1000: 9, 30: 2}, {700: 100, 648: 100}, {683: 50, 682: 30}])
def test_plan_places_all(counts):
    histogram = np.zeros(2049, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    runs = packing.plan(histogram)
    placed = np.zeros(2049, np.int64)
    rooms = {}
    for length, first, number, sequence, offset in runs.tolist():
        assert first == placed[length]
        placed[length] += number
        for s in range(sequence, sequence + number):
            rooms.setdefault(s, []).append((offset, length))
    assert (placed == histogram).all()
    for places in rooms.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
