"""Golden cases and brute force for operators that SQL checks only in part."""

import datetime
import itertools
import json
import quopri
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regista.functions import texts
from regista.operators import matching, mentions, multiset, scoring, similarity, substring, token_spans
from regista.operators.graph import components
from regista.plans import evidence, grading, sources, state, views
from regista.plans.registry import ORACLES
from regista.plans.streams import live_state
from regista.sources import files, imports, sinks
from regista.streaming import jobs

DAY = datetime.date


@pytest.mark.parametrize(("wording", "date", "confidence"), [
    ("", None, "none"), ("2026-07-29", DAY(2026, 7, 29), "exact"), ("hard stop for us: 2026-09-30, hopefully 2026-08-01", DAY(2026, 9, 30), "conditional"), ("w/c 2026-08-05", DAY(2026, 8, 3), "high"),
    ("on 2026-08-05 or so", DAY(2026, 8, 5), "high"), ("2026-08-05 or 2026-08-09", DAY(2026, 8, 9), "conditional"), ("by month end", DAY(2026, 7, 31), "medium"), ("by Friday", DAY(2026, 7, 31), "medium"),
    ("end of the week", DAY(2026, 7, 31), "medium"), ("a couple of weeks", DAY(2026, 8, 12), "low"), ("within a week", DAY(2026, 8, 5), "low"), ("next Wednesday", DAY(2026, 8, 5), "high"),
    ("Monday the 3rd", DAY(2026, 8, 3), "high"), ("Tuesday 31st", None, "none"), ("soon", None, "none"),
])
def test_dates(spark, wording, date, confidence):
    row = spark.range(1).select(texts.resolve_date(F.lit(wording), F.lit("2026-07-29").cast("date")).alias("r")).first().r
    assert (row.date, row.confidence) == (date, confidence)


@pytest.mark.parametrize(("text", "high"), [
    ("I'll send you the meter readings by Friday, the spring ones are on file", {"explicit-action", "explicit-date"}), ("I’ll have the pump drawings completed by Friday", {"explicit-date"}),
    ("the valves were checked by Friday last year", set()), ("the canteen opens late next Wednesday", set()), ("The inspection is on Monday 14th at 10:30", {"scheduled-time"}), ("", set()),
    ("we've renamed the gauge status", {"live-config-act"}), ("I'll change seats on the train", set()), ("please log this as issue", {"explicit-register"}),
])
def test_markers(spark, text, high):
    found = spark.range(1).select(texts.markers(F.lit(text)).alias("m")).first().m
    assert {m.marker_type for m in found if m.confidence == "high"} == high


def test_transcript(spark):
    text = "WEBVTT\n\nNOTE x\n\n00:00:01.000 --> 00:00:02.500\n<v Ann Lee>Hello &amp; <b>hi</b>\n\n00:03.000 --> 00:04.000\nstill me\n\n1\n00:05.000 --> 00:06.000\n<v Bob>Yes</v>\n\n00:07.000 --> 00:08.000\nwho?\n\n00:09.000 --> 00:10.000\nCarl Doe: fine\n"
    got = files.vtt_segments(spark.createDataFrame([(1, text)], "source_id long, text string")).orderBy("seq").collect()
    assert [(r.start_ms, r.end_ms, r.speaker, r.text) for r in got] == [(1000, 2500, "Ann Lee", "Hello & hi"), (3000, 4000, "Ann Lee", "still me"), (5000, 6000, "Bob", "Yes"), (7000, 8000, None, "who?"), (9000, 10000, "Carl Doe", "fine")]


def test_mail(spark):
    rows = [(1, "From: A <a@x>\nSubject: Hello\n there\nContent-Transfer-Encoding: quoted-printable\n\ncaf=C3=A9 =\nau lait\n\nbye"), (2, "From: B\r\nSubject: S\r\nContent-Type: text/html\r\n\r\n<p>Hi &lt;you&gt;</p>"), (3, "Subject: S\nContent-Transfer-Encoding: base64\n\naGVsbG8=")]
    got = {r.source_id: (r.sender, r.subject, r.body) for r in files.mail(spark.createDataFrame(rows, "source_id long, text string")).collect()}
    assert got == {1: ("A <a@x>", "Hello there", "café au lait\n\nbye"), 2: ("B", "S", "Hi <you>"), 3: ("", "S", "hello")}


def test_quoted_printable_is_decoded_as_python_does_without_a_python_worker(spark):
    draw = random.Random(1)
    parts = ["=", "==", "=\n", "=4", "=C3=A9", "=41", "%41", "+", "%", "a", " ", "\n", "é", "日", "=zz", "=0a", "=3D"]
    bodies = ["".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(500)] + ["==4a", "=4=\na", "x=", ""]
    head = "From: A\nContent-Transfer-Encoding: quoted-printable\n\n"
    table = spark.createDataFrame([*enumerate(bodies)], "source_id long, text string")
    got = {r.source_id: r.body for r in table.select("source_id", files.quoted_printable("text").alias("body")).collect()}
    assert got == {i: quopri.decodestring(b.encode()).decode("utf-8", "replace") for i, b in enumerate(bodies)}
    mails = files.mail(table.select("source_id", F.concat(F.lit(head), "text").alias("text")))
    assert "Python" not in mails._jdf.queryExecution().executedPlan().toString()


def test_scan_completeness_and_word_files(spark, tmp_path):
    xml = '<w:document><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04 cut")
    (tmp_path / "c.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\n")
    (tmp_path / "d.eml").write_text("From: x\nSubject: y")
    (tmp_path / "e.txt").write_bytes(b" \n")
    (tmp_path / "f.bin").write_bytes(b"x")
    scanned = files.scan(spark, str(tmp_path))
    reasons = {r.path.rsplit("/", 1)[1]: (r.kind, r.reason) for r in scanned.withColumn("reason", files.completeness("kind", "content")).collect()}
    assert reasons == {"a.docx": ("docx", None), "b.docx": ("docx", "no end record"), "c.vtt": ("vtt", "ends on a timing line"), "d.eml": ("eml", "no body"), "e.txt": ("txt", "empty"), "f.bin": ("unsupported", None)}
    got = files.docx_segments(scanned.where("path LIKE '%a.docx'")).orderBy("k").collect()
    assert [(r.style, r.text) for r in got] == [("Heading1", "Title"), ("", "one two")]


def test_imports(spark, tmp_path):
    doc = {"schemaVersion": 1, "asOf": "x", "projects": [{"id": "P", "name": "n", "actions": [{"id": "A1"}, {"id": "A2"}], "milestones": [{"id": "M1"}]}, {"id": "Q", "decisions": [{"id": "D1"}]}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    counts = {r.entity: r.n_rows for r in imports.import_counts(imports.portfolio(spark, str(tmp_path / "p.json"))).collect()}
    assert counts["projects"] == 2 and counts["actions"] == 2 and counts["milestones"] == 1 and counts["decisions"] == 1 and counts["activity"] == 0
    packet = {"Decisions": [{"ID": "D1"}, {"External-ID": "D2"}, {"x": "1"}], "Actions": {"rows": [{"ref": "A1"}, {"ref": "A1"}]}, "Other": [{"id": "O"}]}
    got = imports.packets(spark.createDataFrame([("k", json.dumps(packet))], "packet string, text string"), ["Decisions", "Actions"]).collect()
    assert sorted((r.register_name, r.external_id or "", r.reason or "") for r in got) == [("Actions", "A1", "repeated id"), ("Actions", "A1", "repeated id"), ("Decisions", "", "missing id"), ("Decisions", "D1", ""), ("Decisions", "D2", "")]


def test_packets_whose_texts_change_when_made_again(spark):
    """Lists gathered anew may come in another order; a packet that arrives twice is refused once all the same."""
    import uuid

    text = F.udf(lambda n: json.dumps({"Decisions": [{"id": uuid.uuid4().hex}], "number": n})).asNondeterministic()
    sent = spark.range(6).select(F.col("id").cast("string").alias("k"), text("id").alias("text")).select(F.explode(F.array("k", F.concat("k", F.lit("-again")))).alias("packet"), F.lit("C").alias("code"), "text")
    got = sorted((r.packet, r.register_name, r.reason) for r in imports.imported(sent, ["Decisions"]).collect())
    assert got == sorted(x for k in range(6) for x in ((f"{k}", "Decisions", None), (f"{k}-again", None, "same content")))


def test_portfolio_records_in_one_pass(spark, monkeypatch):
    """The records of all tables, from one reading of the documents."""
    docs = [{"projects": [{"id": "P", "name": "n", "actions": [{"id": "A1", "title": "t", "status": "s", "dueDate": "d"}, {"id": "A2"}], "milestones": []}, {"id": "Q", "decisions": [{"id": "D1"}]}]}, {"projects": []}, {}]
    d = spark.createDataFrame([(json.dumps(x),) for x in docs] + [("no json",), (None,)], "text string")
    got = imports.portfolio_records(d)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("projects", "P", "P", "n", None, None), ("actions", "P", "A1", "t", "s", "d"), ("actions", "P", "A2", None, None, None), ("projects", "Q", "Q", None, None, None), ("decisions", "Q", "D1", None, None, None)], key=str)
    monkeypatch.setattr(sources, "portfolio_documents", lambda spark, sf: d)
    plan = sources.import_entities(spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and sum(tuple(r)[0] == "projects" for r in sources.import_entities(spark, "").collect()) == 2


def test_a_budget_that_is_just_met(spark):
    """10.3 + 189.24 + 0.46 is 200.00000000000003 in doubles in some orders; the limit is not passed in any."""
    for order in itertools.permutations((10.3, 0.46, 189.24)):
        e = spark.createDataFrame([(k, "2024-01-01", 1, t, v) for k, (t, v) in enumerate(zip("abc", order))] + [(9, "2024-01-02", 1, "a", float("nan")), (10, "2024-01-03", 1, "a", None), (11, "2024-01-04", 1, "a", 1e20)], "event_id long, ts string, user_id long, event_type string, value double")
        got = {str(r.day)[-1]: (str(r.tokens), r.outcome) for r in evidence.budgets(e.coalesce(1)).collect()}
        assert got == {"1": ("200.0", "ok"), "2": ("nan", "blocker"), "3": ("None", "ok"), "4": ("1e+20", "blocker")}


def test_tokens_at_the_limit_are_added_in_the_order_of_events_as_the_sql_adds_them(spark, tmp_path):
    import duckdb

    rows = [(9 * u + k, "2024-01-01", u, t, v) for u, order in enumerate(itertools.permutations((10.3, 0.46, 189.24))) for k, (t, v) in enumerate(zip("abc", order))]
    rows += [(100, "2024-01-02", None, "a", 200.0), (101, None, None, "a", 200.0), (102, "2024-01-03", 7, "a", None)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {(u, str(d)[:10] if d is not None else "None", o) for u, d, o in con.sql("SELECT user_id, day, outcome FROM (" + ORACLES["cost_budget"] + ")").fetchall()}
    assert {o for _, _, o in want} == {"ok", "blocker"}
    got = evidence.budgets(e.repartition(3), ["event_id", "ts"]).collect()
    assert {(r.user_id, str(r.day), r.outcome) for r in got} == want


def test_components_of_random_graphs(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(55)] + [(i, i + 1) for i in range(100, 160)] + [(200, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("threshold", [0.35, 0.6, 0.75])
def test_dice_pairs_lose_nothing(spark, threshold):
    draw = random.Random(8)
    sets = [(p, i, sorted(draw.sample("abcdefghijkl", draw.randrange(1, 7)))) for p in "xy" for i in range(40)]
    got = {(r.project_id, r.left_id, r.right_id, round(r.dice, 9)) for r in similarity.dice_pairs(spark.createDataFrame(sets, "project_id string, row_id long, tokens array<string>"), threshold).collect()}
    want = set()
    for (p, i, a), (q, j, b) in itertools.combinations(sets, 2):
        dice = 2 * len(set(a) & set(b)) / (len(a) + len(b))
        if p == q and dice >= threshold - 1e-12:
            want.add((p, i, j, round(dice, 9)))
    assert got == want


def test_dice_pairs_of_two_tables_leave_their_blocks_only_when_alike(spark, monkeypatch):
    """Many blocks, rows of one size over several of them, nulls and empty rows; the pairs come straight out of the blocks, so
    that none is shuffled before it is known to be alike."""
    monkeypatch.setattr(similarity, "SMALL", 40)
    monkeypatch.setattr(similarity, "PLACES", 7)
    draw = random.Random(5)
    make = lambda k: [(draw.choice("xy"), 2 * i + k, sorted(draw.sample("abcdefghijkl", draw.randrange(0, 5)))) for i in range(60)] + [(None, 900 + k, ["a"])]
    one, two = make(0), make(1)
    table = lambda rows: spark.createDataFrame(rows, "project_id string, row_id long, tokens array<string>")
    for t in (0.35, 0.75):
        pairs = similarity.dice_pairs(table(one), t, other=table(two))
        plan = pairs._jdf.queryExecution().optimizedPlan().toString().strip()
        assert plan.startswith("FlatMapGroupsInArrow")
        want = {(p, i, j, len(set(a) & set(b))) for p, i, a in one for q, j, b in two if p == q and p and a and b and 2 * len(set(a) & set(b)) >= t * (len(a) + len(b)) - 1e-9}
        assert sorted((r.project_id, r.left_id, r.right_id, r.shared) for r in pairs.collect()) == sorted(want)


def test_elements_of_pairs_are_counted_by_blocks_not_by_pairs(spark, monkeypatch):
    """Every pair of a group of near copies, its shared elements against brute force; a row without any, and a row's elements
    travel once for each block it has partners in."""
    monkeypatch.setattr(similarity, "SMALL", 200)
    draw = random.Random(6)
    sets = [("x", i, sorted(draw.sample(range(-15, 15), 20)), [] if i == 5 else sorted(draw.sample(range(-9, 9), draw.randrange(1, 9)))) for i in range(60)]
    table = spark.createDataFrame([(p, i, [str(t) for t in ts], e) for p, i, ts, e in sets], "project_id string, row_id long, tokens array<string>, elements array<long>")
    pairs = similarity.dice_pairs(table.where("row_id % 2 = 0").drop("elements"), 0.35, other=table.where("row_id % 2 = 1").drop("elements"))
    out = similarity.also_shared(pairs, table.select("row_id", "elements"), "bigrams")
    of = {i: (set(ts), set(e)) for _, i, ts, e in sets}
    want = {(a, b): len(of[a][1] & of[b][1]) for a in of for b in of if a % 2 == 0 and b % 2 == 1 and 2 * len(of[a][0] & of[b][0]) >= 0.35 * 40 - 1e-9}
    assert {(r.left_id, r.right_id): r.bigrams for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().strip().startswith("FlatMapCoGroupsInArrow")


def test_bigrams_of_pairs_do_not_travel_by_pair(spark, tmp_path):
    """In the evidence of pairs no join that follows the pairs carries lists."""
    g = spark.createDataFrame([("x", i, i % 2, ["a", "b", "c", str(i % 3)], "s") for i in range(12)], "project_id string, row_id long, side int, toks array<string>, source string")
    facts = grading.pair_facts(g)
    got = {(r.left_id, r.right_id): r.bigrams for r in facts.collect()}
    assert got == {(a, b): 3 if a % 3 == b % 3 else 2 for a in range(0, 12, 2) for b in range(1, 12, 2)}
    above = facts._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    assert "grams_left" not in above and "array_intersect" not in above


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    draw = np.random.default_rng(seed)
    q = np.where(draw.random((n, m)) < 0.6, draw.integers(1, 9, (n, m)), 0)
    weight = np.where(q > 0, 100 + q, 0)
    got = matching.assign([(i, j, int(weight[i, j])) for i, j in np.argwhere(weight > 0).tolist()])
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
    small, big = sorted((n, m))
    w = weight if n <= m else weight.T
    best = max(sum(w[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
    assert sum(weight[i, j] for i, j in got) == best


def test_matching_rows(spark):
    pairs = [(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.85), (3, 12, 0.5), (4, 13, 0.5), (4, 14, 0.6)]
    df = spark.createDataFrame(pairs, "left_id long, right_id long, quality double")
    for task_pairs in (1000, 3, 0):
        got = sorted(tuple(r) for r in matching.match_rows(df, task_pairs=task_pairs, unit=0.01).collect())
        assert got == [(1, 11), (2, 10), (3, 12), (4, 14)]
    assert matching.match_rows(df.where("false")).collect() == []


def test_an_auction_over_several_tasks_is_optimal(spark):
    draw = np.random.default_rng(2)
    q = {(int(a), int(b)): int(w) for a, b, w in zip(draw.integers(0, 11, 30), draw.integers(0, 9, 30), draw.integers(1, 50, 30))}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in q.items()], "left_id long, right_id long, q long")
    got = [tuple(r) for r in matching.auction(df, block=40).collect()]
    want = matching.assign((a, b, 10_000 + w) for (a, b), w in q.items())
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got}) == len(want)
    assert sum(q[x] for x in got) == sum(q[x] for x in want)


def test_a_long_chain_is_matched_in_one_task():
    pairs = [(k, k + d, 10**9 + (k * 7919 + d * 104729) % 9973) for k in range(20_000) for d in (0, 1)]
    assert len(matching.assign(pairs)) == 20_000


def test_live_state_ignores_late_events(spark, tmp_path):
    rows = [(7, DAY(2024, 1, 1), 10), (14, DAY(2024, 1, 1), 12), (8, DAY(2024, 1, 1), 11)]  # a completion at noon, a resolution before it
    frames = [spark.createDataFrame([(i, datetime.datetime.combine(d, datetime.time(h)), 5, "purchase", 1.0, None)], jobs.EVENTS) for i, d, h in rows]
    for k, order in enumerate(([0, 1, 2], [1, 2, 0])):
        folder = f"file://{tmp_path}/{k}"
        for i in order:
            frames[i].coalesce(1).write.mode("append").parquet(f"{folder}/in")
            now = jobs.keyed(live_state(jobs.event_stream(spark, f"{folder}/in")), folder, ["row_id"])
        assert [(r.status.v, r.n_events) for r in now.collect()] == [("completed", 3)]


def test_streams_go_on_after_a_restart(spark, sf, tmp_path):
    """New sinks and queries take up the checkpoint and the state that earlier ones left, and write what changed only."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    box, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(box)
        now = jobs.keyed(live_state(jobs.event_stream(spark, box)), folder, ["row_id"])
    got = sorted(map(str, state.asserted(now).collect()))
    assert got == sorted(map(str, state.asserted(scoring.replay(views.event_rows(e))).collect()))
    one = e.limit(1)
    one.write.mode("append").parquet(box)
    jobs.keyed(live_state(jobs.event_stream(spark, box)), folder, ["row_id"])
    last = max(p.name for p in (tmp_path / "state/rows/changes").iterdir() if p.name.startswith("epoch="))
    assert [r.row_id for r in spark.read.parquet(f"{folder}/rows/changes/{last}").collect()] == [one.first().user_id]


def test_changes_fold_into_bases(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v long").schema
    sink = jobs.Changed(spark, f"file://{tmp_path}", schema, ["k"], every=2)
    for epoch, rows in enumerate(([(1, 10), (2, 20)], [(2, 21)], [(3, 30)], [(1, 11)], [(4, 40)])):
        for _ in range(2):  # an epoch that is run again has the same effect
            sink(spark.createDataFrame(rows, schema), epoch)
    assert sorted(map(tuple, sink.now().collect())) == [(1, 11), (2, 21), (3, 30), (4, 40)]
    assert sink.bases.known() == [-1, 1, 3] and jobs.Changed(spark, f"file://{tmp_path}", schema, ["k"], every=2).now().count() == 4


def test_inbox_stream(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.txt").write_text("hello")
    (box / "b.txt").write_text("hello")
    (box / "c.txt").write_bytes(b" ")
    (box / "d.tmp").write_text("draft")

    def run():
        sink = jobs.Inbox(spark, f"file://{tmp_path}/out")
        sink.run(jobs.inbox(spark, str(box)), str(tmp_path / "check"))
        return sink

    run()
    (box / "e.txt").write_text("hello")
    (box / "f.txt").write_text("new")
    sink = run()
    assert sorted(r.path.rsplit("/", 1)[1] for r in sink.accepted().collect()) == ["a.txt", "f.txt"]
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in sink.refused().collect()] == [("c.txt", "empty")]


def test_closed_sessions_equal_the_batch(spark, sf):
    import tempfile

    stream = jobs.sessions(jobs.event_stream(spark, sf, "events.parquet"))
    closed = {tuple(r) for r in jobs.drain(stream, "file://" + tempfile.mkdtemp()).collect()}
    batch = {tuple(r) for r in jobs.sessions(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert closed and closed <= batch and len(batch) - len(closed) < 0.2 * len(batch)


def test_sessions_over_batches_equal_the_batch(spark, tmp_path):
    """Events that come out of order join sessions that were apart; sessions behind the watermark leave the state."""
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    batches = [[(1, 0), (1, 50), (2, 5)], [(1, 25), (2, 5), (2, 35)], [(1, 79), (3, 100)], [(1, 1000), (2, 990)], [(1, 1020), (3, 1010)]]
    box = f"file://{tmp_path}/in"
    every = []
    for batch in batches:
        rows = [(k, at(m), u, "click", 1.0, None) for k, (u, m) in enumerate(batch)]
        every += rows
        spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.mode("append").parquet(box)
        now = jobs.keyed(jobs.session_changes(jobs.event_stream(spark, box)), f"file://{tmp_path}/out", ["user_id", "start"]).where("n > 0")
    batch = jobs.sessions(spark.createDataFrame(every, jobs.EVENTS).withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, batch.collect()))


def test_snapshots_swap_whole_versions(spark, tmp_path):
    store = sinks.Snapshots(spark, f"file://{tmp_path}")
    table = lambda n: spark.createDataFrame([(k % 2, k) for k in range(n)], "project_id int, v long")
    assert store.manifest()["version"] == 0
    assert store.commit({"a": table(3), "b": table(1)}, {"seen": 7}) == 1
    base = store.manifest()
    assert store.commit({"a": table(5)}) == 2
    assert [store.read(n, v).count() for n, v in (("a", 1), ("a", 2), ("b", 2), ("a", None))] == [3, 5, 1, 5] and store.manifest()["marks"] == {"seen": 7}
    with pytest.raises(RuntimeError):
        store.commit({"a": table(9)}, base=base)  # another writer was first
    assert store.expire(1) == [1] and store.versions() == [2] and store.read("b").count() == 1 and store.read("a").count() == 5


def test_a_snapshot_and_later_events_are_a_replay(spark, sf, tmp_path):
    store, e = sinks.Snapshots(spark, f"file://{tmp_path}"), views.events(spark, sf)
    for upto in (0, 50, 50, 400, 10**9):
        state.advance(store, e.where(F.col("event_seq") < upto))
    assert sorted(map(str, state.asserted(store.read("replay")).collect())) == sorted(map(str, state.asserted(scoring.replay(e)).collect()))
    assert store.versions() == [1, 2, 3] and state.advance(store, e) == 3


def test_hashes_of_sets_follow_changes(spark):
    rows = lambda *ks: spark.createDataFrame([(k % 2, str(k)) for k in ks], "g int, v string")
    total = lambda r, sign=1: multiset.totals(r, ["g"], F.col("v"), sign)
    seen = lambda t: {r.g: (r.n, r.h) for r in t.select("g", "n", multiset.digest().alias("h")).collect()}
    want = seen(total(rows(1, 2, 3, 3, 8)))
    assert seen(total(rows(3, 8, 1, 3, 2).repartition(3))) == want
    assert seen(multiset.combined(total(rows(1, 2, 4, 5, 5, 3)), total(rows(5, 5, 4), -1), total(rows(8, 3)), group=["g"])) == want
    assert seen(total(rows(1, 2, 3, 8))) != want


def test_mentions_are_whole_words(spark):
    rows = [("p", 1, "The Ops team, OPS!"), ("p", 2, "workshops and laptops"), ("p", 3, "new york-times; New York"), ("q", 4, "ops in new york"), ("p", 5, None), ("p", 6, "york new")]
    table = spark.createDataFrame(rows, "project_id string, row_id long, text string").select("project_id", "row_id", mentions.words("text").alias("words"))
    names = spark.createDataFrame([("p", "ops"), ("p", "New York"), ("p", "new york times"), ("p", ""), ("q", "ops"), ("p", "été")], "project_id string, name string")
    found = mentions.mentions(table, names)
    assert sorted(map(tuple, found.collect())) == [("p", 1, "ops"), ("p", 3, "New York"), ("p", 3, "new york times"), ("q", 4, "ops")]
    assert mentions.mentions(table, names.where("false")).collect() == []


def test_places_of_words_do_not_take_the_whole_row_along(spark):
    """Every place of a long text meets the names: with the text itself beside each place the work grew with its square."""
    table = spark.createDataFrame([("p", 1, ["w"] * 9 + ["new", "york"]), ("p", 2, []), ("p", 3, ["new"])], "project_id string, row_id long, words array<string>")
    found = mentions.mentions(table, spark.createDataFrame([("p", "new york"), ("p", "w")], "project_id string, name string"))
    assert sorted(map(tuple, found.collect())) == [("p", 1, "new york"), ("p", 1, "w")]
    assert "posexplode(words" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_substring_search_equals_a_scan(spark, tmp_path):
    texts = ["New York", "newyork", None, "", "ab", "aaaa", "a.b%c_d", "Ünïcode ÜN", "york new", "aab aaa", "x" * 5000 + "needle"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    index = substring.SubstringIndex(rows, ["k"], "t", f"file://{tmp_path}/index")
    for term in ("new", "york", "NEW YORK", "a", "ab", "aaa", "b%c_", "ün", "ünï", "needle", "zzz", "", "aab aaa b"):
        want = sorted(k for k, t in enumerate(texts) if term.lower() in (t or "").lower())
        assert sorted(r.k for r in index.search(term).collect()) == want, term
    plan = index.postings("york")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_postings_of_substrings_are_lists_by_blocks_of_rows(spark):
    """One row for each trigram of each text is shuffled and sorted no more: the rows of postings do not grow with the texts."""
    rows = spark.range(0, 70_000, 1, 3).selectExpr("id % 7 AS k", "concat('Order ', id, if(id % 5 = 0, ' Machinery', ' Building')) AS t")
    index = substring.SubstringIndex(rows, ["k"], "t")
    assert index.postings("building").count() < 200
    texts = [(k % 7, f"order {k} {'building' if k % 5 else 'machinery'}") for k in range(70_000)]
    for term in ("7 Machinery", "order", "r 69999 b", "der 123", "9 building x", "buildinger"):
        assert sorted(r.k for r in index.search(term).collect()) == sorted(k for k, t in texts if term.lower() in t), term


def test_substring_index_of_no_rows(spark):
    for rows in (spark.createDataFrame([], "k long, t string"), spark.createDataFrame([(1, None), (2, "ab")], "k long, t string")):
        index = substring.SubstringIndex(rows, ["k"], "t")
        assert index.search("abc").collect() == []
        assert sorted(r.k for r in index.search("ab").collect()) == sorted(r.k for r in rows.where("t = 'ab'").collect())


def test_postings_of_a_stretch(monkeypatch):
    """Texts cut into parts lose no trigram; those of other planes and with broken bytes neither."""
    texts = ["new york", "", "ab", "abc", "aaaa" * 9, "\U0001f600\U0001f601\U0010ffff\U0001f600", "ünï\x00code", "x" * 40 + "needle"]
    ids = [(k << 33) + 32_766 + k % 4 for k in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(ids + [5]), pa.array([t.encode() for t in texts] + [b"\xffneed"])], ["__row", "__text"])
    want = {(t[k : k + 3], i) for i, t in zip(ids, texts) for k in range(len(t) - 2)} | {("\ufffdne", 5), ("nee", 5), ("eed", 5)}
    for stretch in (1, 7, 1 << 20):
        monkeypatch.setattr(substring, "STRETCH", stretch)
        rows = [r for out in substring._postings([batch]) for r in out.to_pylist()]
        assert {(r["gram"], (r["block"] << substring.PLACE_BITS) + p) for r in rows for p in r["places"]} == want
    assert len(rows) == len({(r["gram"], r["block"]) for r in rows}) and all(r["places"] == sorted(set(r["places"])) for r in rows)


def by_loop(sizes, target, overlap):
    """Windows (first, last, tokens), from 0, by the rule as it is said."""
    start, out = 0, []
    while start < len(sizes):
        end, total = start, 0
        while end < len(sizes) and (total < target or end == start):
            total += sizes[end]
            end += 1
        out.append((start, end - 1, total))
        if end >= len(sizes):
            break
        back, again = end, 0
        while back > start and again < overlap:
            back -= 1
            again += sizes[back]
        start = max(start + 1, back)
    return out


def packed_by_loop(sizes, most):
    calls, now = [], []
    for k, n in enumerate(sizes):
        if now and sum(sizes[i] for i in now) + n > most:
            calls.append((now[0], now[-1]))
            now = []
        now.append(k)
    return calls + [(now[0], now[-1])]


def test_windows_and_calls_equal_a_loop(spark):
    pick = random.Random(5)
    sources = [[5], [600, 700], [100] * 30, [10, 900, 10, 10, 480, 55, 400], [0] * 7, [0, 0, 50, 0], [3000, 1, 1, 3000]]
    sources += [[pick.choice([0, 1, 7, 30, 30, 90, 700]) for _ in range(pick.randint(1, 60))] for _ in range(40)]
    rows = [(k, 3 * i + 1, n) for k, sizes in enumerate(sources) for i, n in enumerate(sizes)]
    pick.shuffle(rows)
    for block in (1, 20):
        got = token_spans.windows(spark.createDataFrame(rows, "source_id long, seq long, n long"), 100, 25, block).collect()
        for k, sizes in enumerate(sources):
            mine = sorted((r.window_seq, (r.first_seq - 1) // 3, (r.last_seq - 1) // 3, r.n_tokens) for r in got if r.source_id == k)
            assert mine == [(i, *w) for i, w in enumerate(by_loop(sizes, 100, 25))]
        calls = token_spans.calls(spark.createDataFrame(rows, "source_id long, seq long, n long"), 100, block).collect()
        for k, sizes in enumerate(sources):
            mine = sorted((r.call_no, (r.first_seq - 1) // 3, (r.last_seq - 1) // 3) for r in calls if r.source_id == k)
            assert mine == [(i, *w) for i, w in enumerate(packed_by_loop(sizes, 100))]


def test_windows_of_one_long_source(spark):
    sizes = [(k * 7919) % 40 for k in range(60_000)]
    rows = spark.range(len(sizes)).select(F.lit(1).cast("long").alias("source_id"), F.col("id").alias("seq"), ((F.col("id") * 7919) % 40).alias("n"))
    got = token_spans.windows(rows, 500, 60).select("first_seq", "last_seq", "n_tokens").collect()
    assert sorted(map(tuple, got)) == by_loop(sizes, 500, 60)
    assert token_spans.windows(rows.where("false"), 500, 60).collect() == []


def test_classes_of_differences_by_hand(spark):
    g = spark.createDataFrame([
        ("p", 0, 2, 1, ["a", "b", "c", "d"], "s1", 1), ("p", 0, 4, 1, ["e", "f", "g", "h"], "s1", 1), ("p", 0, 6, 1, ["i", "j", "k", "l"], "s1", 1), ("p", 0, 8, 1, ["z"], "s1", 1),
        ("p", 1, 1, 1, ["a", "b", "c", "d"], "s2", 1), ("p", 1, 3, 1, ["e", "f", "g", "x"], "s1", 1), ("p", 1, 5, 1, ["e", "f", "h", "y"], "s1", 1), ("p", 1, 7, 2, ["q", "r"], "s1", 1), ("p", 1, 9, 1, ["i", "j", "n", "o"], "s1", 1), ("p", 1, 11, 1, ["u", "v"], "s1", 1),
    ], "project_id string, side long, row_id long, n_copies long, toks array<string>, source string, n_chars long")
    e = grading.pair_facts(g)
    none = spark.createDataFrame([], "left_id long, right_id long")
    got = {r.row_id: r["class"] for r in grading.classified(g, e, none).collect()}
    assert got == {
        2: "benchmark-disagreement", 4: "alternative-decomposition", 6: "genuine-miss", 8: "genuine-miss", 1: "benchmark-disagreement", 3: "alternative-decomposition",
        5: "alternative-decomposition", 7: "possible-duplicate", 9: "alternative-decomposition", 11: "genuine-addition",
    }


def test_versions_of_the_weights():
    weights = scoring.WEIGHTS
    assert scoring.faults(weights) == []
    assert scoring.faults({k: v for k, v in weights.items() if k != "bands"}) == ["bands missing"]
    assert scoring.faults(weights | {"stale_days": "many"}) == ["stale_days not numeric"]
    assert scoring.faults(weights | {"bands": {"now": 1, "soon": 2, "watch": 3}}) == ["bands out of order"]
    assert scoring.active([("a", True, weights), ("b", False, {})])[0] == "a"
    for bad in ([("a", False, weights)], [("a", True, weights), ("b", True, weights)], [("a", True, {})]):
        with pytest.raises(ValueError):
            scoring.active(bad)


def test_places_in_groups(spark):
    from regista.operators.ranking import placed

    draw = random.Random(2)
    rows = [("a" if i % 3 else "b", i, draw.randrange(5) or None) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id long, v int").repartition(7)
    got = {r.id: r.place for r in placed(df, ["g"], [F.col("v").desc_nulls_last(), F.col("id")], "place").collect()}
    for g in "ab":
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        assert [got[r[1]] for r in want] == list(range(1, len(want) + 1))


def test_rows_that_meet_many_blocks_are_shuffled_once(spark, monkeypatch):
    """A dozen blocks meet each other; what is shuffled after them are the meetings, not the rows again for each."""
    monkeypatch.setattr(similarity, "SMALL", 50)
    monkeypatch.setattr(similarity, "BLOCK", 50)
    monkeypatch.setattr(similarity, "GIVEN", 7)
    draw = random.Random(9)
    sets = [("a b/ü", i, sorted(draw.sample("abcdefghijkl", 6))) for i in range(100)]
    pairs = similarity.dice_pairs(spark.createDataFrame(sets, "project_id string, row_id long, tokens array<string>"), 0.8)
    got = {(r.left_id, r.right_id, r.shared) for r in pairs.collect()}
    assert got == {(i, j, len(set(a) & set(b))) for (_, i, a), (_, j, b) in itertools.combinations(sets, 2) if len(set(a) & set(b)) >= 5}
    assert pairs.select("block_b").distinct().count() > 10
    read = pairs._jdf.queryExecution().optimizedPlan().children().head()  # all that the pairs are made of
    assert "tokens" not in read.toString()


def test_a_weak_token_alone_does_not_link(spark, tmp_path):
    """Titles alike only in what a quarter of the rows hold are no pair, whether near or equal."""
    texts = ["alpha beta gamma delta"] * 2 + ["alpha beta gamma epsilon"] + ["alpha beta gamma"] * 2 + [f"word{i}x solo{i}y" for i in range(8)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    from regista.plans import analytics

    assert {(r.left_id, r.right_id) for r in analytics.lexical(spark, str(tmp_path)).collect()} == {(0, 1)}


@pytest.mark.parametrize("dense", [0.0, 0.05, 2.0])
def test_shared_tokens_are_counted_by_columns_and_by_postings(dense, monkeypatch):
    """Two blocks and one with itself against brute force, with all tokens in a matrix, some and none, in small stretches; no
    pair is counted token by token, so the work does not follow the candidates."""
    for name, value in (("HIGH", 3), ("WIDE", 5), ("PLACES", 7), ("DENSE", dense)):
        monkeypatch.setattr(similarity, name, value)
    draw = random.Random(11)
    sets = [draw.sample(range(30), draw.randrange(1, 20)) + [99] * (k % 3 == 0) for k in range(50)]
    ids, n, values = np.arange(50) * 3, np.array([len(s) for s in sets]), np.array([t for s in sets for t in s], dtype=np.int64)
    for left in (np.ones(50, dtype=bool), np.arange(50) < 20):
        for t in (0.35, 0.6, 1.0):
            got = sorted((*sorted((int(a), int(b))), int(s)) for x, y, z in similarity._similar(ids, n, values, left, t) for a, b, s in zip(x, y, z))
            both = ((a, b, len(set(sets[a]) & set(sets[b]))) for a, b in itertools.combinations(range(50), 2) if left.all() or left[a] != left[b])
            assert got == sorted((a, b, s) for a, b, s in both if 2 * s >= t * (len(sets[a]) + len(sets[b])) - 1e-9)


def test_copies_are_in_all_pairs_links_and_matches(spark, tmp_path, monkeypatch):
    """Rows that repeat a text are paired, linked and matched like any other row, also where their group is dealt over chunks."""
    from regista.plans import analytics

    monkeypatch.setattr(similarity, "MEMBERS", 2)
    texts = ["alpha beta gamma delta"] * 9 + ["alpha beta gamma epsilon"] * 3 + [f"word{i}x solo{i}y" for i in range(60)]
    spark.createDataFrame([(7 * i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    alike = range(12)
    of = {7 * i: set(texts[i].split()) for i in alike}
    links = [(r.left_id, r.right_id, r.shared) for r in analytics.lexical_edges(spark, str(tmp_path)).collect()]
    assert sorted(links) == sorted((7 * i, 7 * j, len(of[7 * i] & of[7 * j])) for i, j in itertools.combinations(alike, 2))
    want = {(a, b) for a in of for b in of if a % 2 == 0 and b % 2 == 1}
    for query in (grading.pair_evidence, grading.acceptable_pairs):
        pairs = [(r.left_id, r.right_id) for r in query(spark, str(tmp_path)).collect()]
        assert len(pairs) == len(want) and set(pairs) == want
    got = grading.row_matching(spark, str(tmp_path)).collect()
    assert len({r.left_id for r in got}) == len({r.right_id for r in got}) == len(got) == 6


def test_accepted_pairs_are_those_of_the_whole_evidence(spark):
    """Aligned rows below 0.45 meet by their ids, the others by their tokens; both are in the evidence from 0.35 on."""
    draw = random.Random(8)
    rows = [("x", i, i % 2, sorted(draw.sample("abcdefghijklmnop", draw.randrange(2, 9))), "s") for i in range(120)]
    g = spark.createDataFrame(rows, "project_id string, row_id long, side int, toks array<string>, source string")
    pairs = lambda df: sorted((r.left_id, r.right_id, round(r.quality, 9)) for r in df.collect())
    want = pairs(grading.acceptable(grading.pair_facts(g)))
    assert pairs(grading.accepted(g)) == want and any(q < 0.4 + 0.45 and a // 10 == b // 10 for a, b, q in want)


def test_an_inbox_passes_no_key_through_python_and_gives_first_files_once(spark, tmp_path):
    """Three batches with a hash again in a later one under a lesser path; a run again from the checkpoint gives nothing new."""
    box = f"{tmp_path}/box"
    table = lambda rows: spark.createDataFrame(rows, "hash string, path string, kind string, length long").coalesce(1)
    table([("a", "p3", "txt", 1), ("a", "p2", "md", 2), ("b", "p9", "txt", 1)]).write.mode("append").parquet(box)
    stream = lambda: jobs.first_seen(spark.readStream.schema("hash string, path string, kind string, length long").parquet(box))
    out = jobs.Epochs(spark, f"file://{tmp_path}/out", stream().schema)
    for more in ([("a", "p1", "txt", 1), ("c", "p0", "txt", 7)], [("c", "p1", "txt", 1), ("b", "p1", "txt", 1)], []):
        jobs.run(stream(), out.write, f"{tmp_path}/checkpoint", "update")
        if more:
            table(more).write.mode("append").parquet(box)
    assert sorted(out.all().collect()) == [("a", "p2", "md", 2), ("b", "p9", "txt", 1), ("c", "p0", "txt", 7)]
    assert "InPandas" not in stream()._jdf.queryExecution().analyzed().toString()


def test_word_files_leave_a_worker_in_small_pieces(spark, monkeypatch):
    """Pieces end where they hold the bytes given at a time; nulls, a file that is no zip and an empty batch."""
    import pyarrow as pa

    monkeypatch.setattr(files, "GIVEN", 10)
    batch = pa.record_batch({"path": ["a", "b", "c", "d"], "body": ["x" * 6, None, "y" * 6, "z"]})
    pieces = list(files._each(lambda v: v, "body", "content", pa.string())([batch, batch.slice(0, 0)]))
    assert [p.to_pydict() for p in pieces] == [{"path": ["a", "b", "c"], "content": ["x" * 6, None, "y" * 6]}, {"path": ["d"], "content": ["z"]}]
    odd = spark.createDataFrame([("n", None), ("e", ""), ("t", "one <b> & two\nthree")], "source_id string, text string")
    assert sorted((r.path, r.k, r.text) for r in files.docx_segments(files.docx_files(odd)).collect()) == [("t.docx", 0, "one <b> & two"), ("t.docx", 1, "three")]
    assert files.docx_xml(spark.createDataFrame([("x", b"PK no zip")], "path string, content binary")).collect() == [("x", None)]


def test_a_snapshot_does_not_deal_out_its_rows_again(spark, tmp_path):
    """Committing a table partitioned by project has no shuffle of its own."""
    store = sinks.Snapshots(spark, f"file://{tmp_path}")
    tracker, before = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    version = store.commit({"rows": spark.range(100).selectExpr("id % 3 AS project_id", "id")})
    jobs_ = range(before, spark.sparkContext._jsc.sc().dagScheduler().nextJobId())
    assert all(len(tracker.getJobInfo(j).stageIds) == 1 for j in jobs_)
    assert store.read("rows", version).groupBy("project_id").count().orderBy("project_id").collect() == [(0, 34), (1, 33), (2, 33)]
