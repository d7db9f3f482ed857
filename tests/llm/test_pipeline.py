import collections

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from regista.llm import pii, quality_rules
from tests.llm.test_corpus_operators import lines_by_hand, near_by_hand

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(i, n=60):
    return " ".join(f"word{(i * 7 + j * j) % 97} of{j % 5}" for j in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rows = [(i, prose(i) + f"\nline {i}\nsecond {i}", "en", "s1", 1) for i in range(12)]
    rows += [(3, prose(3), "en", None, None), (3, prose(3), "en", None, None), (None, prose(40), None, None, None), (None, None, None, None, None), (20, "", "de", "s", 0), (21, " \n ", "de", "s", 3)]
    rows += [(22, "\n".join(prose(50 + j) for j in range(200)), "en", "long", 9), (23, prose(4) + " mail me at ann.lee@mail.org", "en", "s", 5)]
    return spark.createDataFrame(rows, COLUMNS)


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_quality_stage(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.select(*[c for c in ("doc_id", "text", "lang", "source", "n_chars")]).unionByName(odd)
    got = corpus_pipeline.quality(spark, docs, sf)
    assert got.columns == docs.columns
    kept = {(r.doc_id, r.n_words, r.word_chars) for r in quality_rules.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.kept}
    want = [r for r in docs.collect() if (r.doc_id, *quality_rules.measure(r.text or "")[:2]) in kept]
    assert sorted(map(key, got.collect())) == sorted(map(key, want))


def test_line_stage(spark, sf, odd):
    rows = [r for r in odd.dropDuplicates(["doc_id", "text"]).collect() if r.doc_id is not None]
    rows = list({r.doc_id: r for r in rows}.values())
    docs = spark.createDataFrame([tuple(r) for r in rows] + [(60, rows[0].text, "x", "y", 1), (61, "own\n" + rows[-1].text, "x", "y", 1)], COLUMNS)
    got = {r.doc_id: r for r in corpus_pipeline.lines(spark, docs, sf).collect()}
    hand = lines_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    for d, (text, removed, _) in hand.items():
        if d in got and removed and max(len(x.split()) for x in text.split("\n")) < corpus_pipeline.LONG_PASSAGE:
            assert got[d].text == text
    assert 60 not in got or got[60].text != rows[0].text
    assert all(r.n_chars is None and r.text is None or r.n_chars == len(r.text) for r in got.values())
    assert set(got) | {d for d, (t, n, _) in hand.items() if n} >= set(hand)  # only documents that lost lines may go


def test_near_copy_stage(spark, sf, odd):
    got = corpus_pipeline.near_copies(spark, odd, sf)
    assert got.columns == odd.columns
    rows = odd.collect()
    classes = near_by_hand([(i, r.text) for i, r in enumerate(rows)])
    sizes = collections.Counter(c for _, c, _, n in classes)
    wordless = sum(n == 0 for *_, n in classes)
    assert got.count() == len(sizes) and wordless == 3
    assert {r.text for r in got.collect()} <= {r.text for r in rows}


def test_personal_data_stage(spark, sf, odd):
    got = corpus_pipeline.personal_data(spark, odd, sf)
    assert got.columns == odd.columns
    want = [(r.doc_id, pii.replace(r.text, corpus_pipeline.PII_KEY)[0] if r.text else r.text) for r in odd.collect()]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text)) for r in got.collect())
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())


def test_packing_stage(spark, sf, odd):
    got = corpus_pipeline.packed(spark, odd, sf).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in odd.collect():
        want[r.doc_id] += len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1
    have = collections.Counter()
    for r in got:
        have[r.doc_id] += r.length
    assert have == want and all(0 < r.length <= 2048 for r in got)


def test_stages_take_empty_tables_and_other_columns(spark, sf, odd):
    more = odd.selectExpr("*", "text AS n_removed", "lang AS class_id", "doc_id AS d", "lang AS k", "source AS line_no", "lang AS n_found", "lang AS kept")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), sf).count() == 0, name
        if name != "best-fit packing":
            out = stage(spark, more, sf)
            assert out.columns == more.columns, name
            assert out.count() <= more.count()


def test_run_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    strip = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert strip(corpus_pipeline.run(spark, sf)) == strip(docs)
