"""Importance resampling, phrase collocations and web archives against brute force and SQL, with odd input."""

import hashlib
import math
import os
import random
import re
import struct
import zipfile
import zlib
from collections import Counter

import duckdb
import pytest

from regista.llm import collocations, queries, resampling, warc

DOCS = "doc_id long, text string, lang string, place string, bucket int, n long"


def _features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _resampled(docs, target, percent):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(_features(text)[1])
    for text in target:
        t.update(_features(text)[1])
    all_s, all_t = s.total() + 10000, t.total() + 10000
    rows = []
    for key, text in docs:
        words, found = _features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in found)
        h = int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    ranks = {r[0]: k + 1 for k, r in enumerate(fit[: len(fit) * percent // 100])}
    return sorted((*r[:4], ranks.get(r[0])) for r in rows)


def test_resampling_equals_brute_force(spark, monkeypatch):
    pick = random.Random(1)
    words = [*"alpha beta gamma Delta ÄPFEL 北京 x1 naïve don't".split(), "long" * 40, "z" * 300]
    docs = [(k, " ".join(pick.choices(words, k=pick.choice([0, 3, 19, 20, 25, 90])))) for k in range(120)]
    docs += [(200, None), (201, ""), (202, " ,;.. "), (-5, "Alpha-beta " * 5000), (2**62, "beta " * 25), (203, "q" * 9000 + " alpha" * 30)]
    target = ["alpha beta gamma", None, "x1 beta 北京"]
    table = spark.createDataFrame([(k, t, "en", "p", 1, 2) for k, t in docs], DOCS).repartition(3)
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    want = _resampled(docs, target, 5)
    assert sorted(map(tuple, resampling.resample(table, aim).collect())) == want
    drawn = resampling.draw(table, aim)
    assert drawn.columns == table.columns and {r.doc_id for r in drawn.collect()} == {r[0] for r in want if r[4]}
    # pieces of long texts change nothing: the tasks' modules are this process's own only in the helper
    monkeypatch.setattr(resampling, "PIECE", 50)
    runs = resampling._Runs()
    for _, text in docs[:60] + docs[-3:]:
        found = Counter()
        for some, doc, known in resampling._pieces([(text or "").encode().translate(resampling._FOLD)]):
            found.update(runs.features(some, doc, known)[0].tolist())
        assert found == Counter(_features(text)[1])


def test_resampling_of_odd_tables(spark):
    aim = spark.createDataFrame([(1, "alpha")], "item_id int, text string")
    empty = spark.createDataFrame([], DOCS)
    assert resampling.resample(empty, aim).collect() == []
    same = spark.createDataFrame([(7, "word " * 30, None, None, None, None)] * 40 + [(None, "word " * 30, None, None, None, None)] * 2, DOCS)
    rows = resampling.resample(same, aim.where("false"), percent=50).collect()
    assert len(rows) == 42 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 22))


@pytest.mark.parametrize("digit,block", [(1, 2), (4, 3), (12, 18)])
def test_radix_ranks_are_those_of_a_sort(spark, digit, block):
    pick = random.Random(digit)
    rows = [(pick.choice([0, 0, 0, 7, -3, 12]), pick.randrange(-9, 9), k) for k in range(60)]
    got = resampling.radix_rank(spark.createDataFrame(rows, "a long, b long, place long").repartition(4), [("a", True), ("b", False), ("place", False)], digit, block)
    want = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(got.collect(), key=lambda r: r["rank"])] == want and {r["rank"] for r in got.collect()} == set(range(1, 61))


def test_radix_ranks_over_all_longs(spark):
    rows = [(-(2**63), 1), (2**63 - 1, 2), (0, 3), (-1, 4), (5, 5), (0, 6)]
    for down in (False, True):
        got = resampling.radix_rank(spark.createDataFrame(rows, "k long, t long"), [("k", down), ("t", False)]).collect()
        assert [(r.k, r.t) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows, key=lambda r: (-r[0] if down else r[0], r[1]))


def _phrases(docs, least, kept):
    f, n = Counter(), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            f.update((lang or "und", *words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    often = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    out = {}
    for (lang, *w), a in often.items():
        if any(q[0] == lang and len(q) > len(w) + 1 and c >= a and any(list(q[i : i + len(w)]) == w for i in range(1, len(q) - len(w) + 1)) for q, c in often.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang]))
    return sorted((lang, rank + 1, p.decode(), -a, x, y, total, -score) for lang, rows in out.items() for rank, (score, a, p, x, y, total) in enumerate(sorted(rows)[:kept]))


@pytest.mark.parametrize("routed", [1, 12, 1 << 18])
def test_collocations_equal_brute_force(spark, routed):
    pick = random.Random(3)
    words = "the of new york city a Ü 北京 x-y \x00 \xa0".split(" ")
    docs = [("".join(pick.choice(words) + pick.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(pick.choice([0, 5, 60]))), pick.choice(["en", "en", "de", None])) for _ in range(90)]
    docs += [("the new york times said so! " * 30, "en"), (None, "en"), ("", None), ("word", "fr"), ("one two three four five six seven " * 40, "it")]
    table = spark.createDataFrame([(k, t, lang, "p", 1, 2) for k, (t, lang) in enumerate(docs)], DOCS).repartition(3)
    got = collocations.mine(table, least=12, kept=40, routed=routed)
    assert sorted(map(tuple, got.collect())) == _phrases(docs, 12, 40)


def test_collocations_of_odd_tables(spark, sf, monkeypatch):
    assert collocations.mine(spark.createDataFrame([], DOCS)).collect() == []
    long = "a b, " * 60_000
    rows = collocations.mine(spark.createDataFrame([(1, long, "en", None, None, None), (1, long, "en", None, None, None)], DOCS)).collect()
    assert [tuple(r) for r in rows] == [("en", 1, "a b", 120_000, 120_000, 120_000, 240_000, 2000)]
    # counts beyond 64 bits in between
    score = spark.sql("select (cast(1000 as decimal(4)) * cast(a as decimal(17)) * cast(a as decimal(17))) div (cast(a as decimal(19)) * cast(7 as decimal(19))) s from values (9876543210987654L) t(a)").first().s
    assert score == 1000 * 9876543210987654 // 7
    monkeypatch.setattr(collocations, "STRETCH", 64)  # in this process: stretches end with pieces and lose nothing
    import pyarrow as pa

    texts = ["one two. three four, " * 9, "x " * 200, "a\nb"]
    some = list(collocations._stretches(iter([pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(texts)], names=["lang", "text"])])))
    assert len(some) >= 3 and sum(int((s.at > 0).sum()) for s in some) == 36 + 200 + 2


def test_collocations_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(queries.OP12_SQL).fetchall()
    assert sorted(map(tuple, queries.op12_collocations(spark, sf).collect())) == sorted(want)


PAGES = "page_id long, url string, html string, digest string, record int"


def _archived(spark, rows, **how):
    pages = spark.createDataFrame([(*r, "other", 1) for r in rows], PAGES).repartition(3)
    return pages, warc.resolved(warc.read_packages(warc.write_packages(pages, **how)))


def test_archives_give_every_page_back(spark):
    big = "<p>" + "ü" * 300 + "</p>"
    rows = [(k, f"https://a.example/{k}", f"<html>{k}" + "x" * k) for k in range(40)]
    rows += [(100, "u", big), (90, "v", big), (90, "w", big), (95, None, big), (None, "n", big), (50, "s", "small"), (51, "t", "small"), (60, None, None), (None, None, ""), (61, "é\r\nWARC-Type: x", "y" * 200_000)]
    _, found = _archived(spark, rows, package=2000)
    got = sorted(found.collect(), key=repr)
    heads = {}
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        heads.setdefault(html or "", (page, url))
    want = []
    for page, url, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and heads[html] != (page, url)
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", heads[html][0] if again else None))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert "é%0D%0AWARC-Type: x" in {r.url for r in got}


def test_rows_that_repeat_a_page_are_one_response(spark):
    _, found = _archived(spark, [(5, "u", "z" * 150)] * 4 + [(5, "u", "tiny")] * 2 + [(9, None, "z" * 150)])
    rows = found.collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows) == {(5, 150, "response", None): 1, (5, 150, "revisit", 5): 3, (9, 150, "revisit", 5): 1, (5, 4, "response", None): 2}


def test_no_page_gives_no_package(spark):
    pages, found = _archived(spark, [])
    assert found.collect() == [] and warc.write_packages(pages).collect() == []


def test_packages_are_zip_files_of_stored_members(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    packages = warc.write_packages(pages).collect()
    assert sum(p.records for p in packages) == pages.count()
    with zipfile.ZipFile(packages[0].path.removeprefix("file://")) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        lines = z.read("indexes/index.cdxj").splitlines()
        assert len(lines) == packages[0].records


def _foreign(path, members, **how):
    with zipfile.ZipFile(path, "w") as z:
        for name, data, method in members:
            z.writestr(zipfile.ZipInfo(name), data, method)
        z.comment = how.get("comment", b"")


@pytest.mark.parametrize("plain", [False, True])
def test_archives_without_index_are_walked(spark, tmp_path, plain):
    rows = [{"page_id": k, "url": f"u{k}", "html": "h" * (k * 997) + "\r\n\r\n", "digest": "0", "record": f"{k:032x}", "refers": None} for k in range(30)]
    import gzip

    data = b"".join(warc._record(r) if plain else gzip.compress(warc._record(r)) for r in rows)
    path = f"{tmp_path}/a.zip"
    _foreign(path, [("archive/x.warc" if plain else "archive/x.warc.gz", data, zipfile.ZIP_STORED), ("notes.txt", b"n", zipfile.ZIP_DEFLATED)], comment=b"PK\x05\x06 is no end" + b"c" * 300)
    got = warc.read_packages(spark.createDataFrame([(path,)], "path string")).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(r["page_id"], r["html"].encode()) for r in rows]


def test_deflated_and_shared_indexes(spark, tmp_path, monkeypatch):
    import gzip
    import json

    rows = [{"page_id": k, "url": f"u{k}", "html": f"page {k}", "digest": "0", "record": f"{k:032x}", "refers": None} for k in range(50)]
    data, lines = b"", []
    for r in rows:
        one = gzip.compress(warc._record(r))
        lines.append(f"key {r['page_id']} " + json.dumps({"filename": "x.warc.gz", "offset": str(len(data)), "length": str(len(one))}))
        data += one
    monkeypatch.setattr(warc, "INDEX", 333)
    for k, method in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)):
        path = f"{tmp_path}/{k}.zip"
        _foreign(path, [("archive/x.warc.gz", data, zipfile.ZIP_STORED), ("indexes/index.cdxj", "\n".join(lines), method)])
        got = warc.read_packages(spark.createDataFrame([(path,)], "path string")).collect()
        assert sorted(r.page_id for r in got) == list(range(50))


def test_zip64_directories(tmp_path):
    many = f"{tmp_path}/many.zip"
    with zipfile.ZipFile(many, "w") as z:
        for k in range(70_000):
            z.writestr(zipfile.ZipInfo(f"m{k}"), b"")
    with warc._Ranges(many) as source:
        assert warc.directory(source)[2] == 70_000 and sum(1 for _ in warc.members(source)) == 70_000
    # a sparse file: the member and the directory lie beyond 4 GB
    far, big = 5 << 30, f"{tmp_path}/far.zip"
    with open(big, "wb") as f:
        f.seek(far)
        name, data = b"archive/x.warc", b"content"
        f.write(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(data), len(data), len(data), len(name), 4) + name + b"\x99\x99\0\0" + data)
        at = f.tell()
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), far)
        f.write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 2**32 - 1, 2**32 - 1, len(name), len(extra), 0, 0, 0, 0, 2**32 - 1) + name + extra)
        size = f.tell() - at
        end = f.tell()
        f.write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, size, at) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        f.write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 1, 1, 2**32 - 1, 2**32 - 1, 0))
    with warc._Ranges(big) as source:
        (m,) = warc.members(source)
        assert (m["size"], m["packed"], m["header"]) == (7, 7, far) and source.read(warc.first_byte(source, far), 7) == b"content"
    os.remove(big)
    with pytest.raises(ValueError):
        bad = f"{tmp_path}/bad"
        open(bad, "wb").write(b"no archive" * 50)
        with warc._Ranges(bad) as source:
            warc.directory(source)


def test_archives_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    got = queries.op13_warc(spark, sf)
    want = con.execute(queries.OP13_SQL).fetchall()
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == sorted(want)
