"""Streaming jobs as queries: each runs over what the event log holds now and returns its result, equal to its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regista.operators import scoring
from regista.plans import evidence, reconcile, runs, state, views
from regista.plans.registry import ORACLES, query
from regista.plans.store import shared_dir
from regista.sources.files import completeness, typed
from regista.streaming import jobs


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, sf) -> DataFrame:
    return jobs.event_stream(spark, sf, "events.parquet")


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    return jobs.drain(stream, _folder(stream.sparkSession), mode)


@query("SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_activity(spark, sf):
    return jobs.keyed(jobs.activity_counts(_events(spark, sf)), _folder(spark), ["start", "end", "event_type"])


@query("SELECT date_trunc('hour', ts) - to_hours(k) AS start, date_trunc('hour', ts) - to_hours(k) + INTERVAL 3 HOUR AS \"end\", event_type, count(*) AS n FROM events, (VALUES (0), (1), (2)) t(k) GROUP BY ALL")
def stream_activity_sliding(spark, sf):
    return jobs.keyed(jobs.activity_counts(_events(spark, sf), "3 hours", "1 hour"), _folder(spark), ["start", "end", "event_type"])


def live_state(events: DataFrame) -> DataFrame:
    """The replay of a stream of events: its state is one entry a register row, and each batch gives the rows it changed."""
    return scoring.replay(views.event_rows(events))


@query(ORACLES["replay_state"], complete=True)
def stream_state(spark, sf):
    """Live state: the replay of the event log, kept by row; late events never win."""
    return state.asserted(jobs.keyed(live_state(_events(spark, sf)), _folder(spark), ["row_id"]))


_REJECTED = f"""SELECT t.event_id AS event_id, t.outcome AS reason FROM ({ORACLES['event_time_check'].strip()}) t WHERE t.outcome <> 'ok'
UNION ALL SELECT f.event_seq, 'not correctable' FROM ({ORACLES['event_field_check'].strip()}) f WHERE NOT f.allowed"""


@query(_REJECTED, complete=True)
def stream_rejected(spark, sf):
    """Events that may not enter the log: bad instants, and fields that their row's register does not let a human correct."""
    e = _events(spark, sf)
    late = e.select("event_id", evidence.time_outcome().alias("reason")).where("reason <> 'ok'")
    named = evidence.field_allowed(views.event_rows(e).where("field IS NOT NULL"), spark, sf).where("NOT allowed")
    return _drained(late).unionByName(_drained(named.select(F.col("event_seq").alias("event_id"), F.lit("not correctable").alias("reason"))))


@query(ORACLES["stalled_jobs"], complete=True)
def stream_stalled(spark, sf):
    """Job updates as they come in, those out of lease or quiet for too long."""
    return _drained(runs.stalled(_events(spark, sf)))


@query(ORACLES["contested_fields"], complete=True)
def stream_contested(spark, sf):
    """Proposals of sources as they come in, against the state that human events have left: those that contradict it."""
    schema = views.read(spark, sf, "orders").schema
    rows = views.register_rows(jobs.table_stream(spark, sf, "orders.parquet", schema), views.read(spark, sf, "customer"))
    return _drained(reconcile.contested(reconcile.proposals(rows), spark, sf))


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (
  SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
    SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS gap FROM events))
GROUP BY user_id, island""")
def stream_sessions(spark, sf):
    """Work sessions of each user, those still open at the end of the log included."""
    return jobs.keyed(jobs.session_changes(_events(spark, sf)), _folder(spark), ["user_id", "start"]).where("n > 0")


def file_rows(spark, sf) -> DataFrame:
    """Documents as files in a folder: a kind of file by id, every ninth a temporary name, null texts as empty files."""
    name = F.concat(F.lit("inbox/"), F.when(F.col("doc_id") % 9 == 0, "~$").otherwise(""), F.lit("doc-"), F.col("doc_id").cast("string"), views.pick([".txt", ".md", ".VTT", ".eml", ".bin"], F.col("doc_id") % 5))
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return views.read(spark, sf, "documents").select(name.alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


_FILES = """(SELECT 'inbox/' || CASE WHEN doc_id % 9 = 0 THEN '~$' ELSE '' END || 'doc-' || doc_id || ['.txt', '.md', '.VTT', '.eml', '.bin'][doc_id % 5 + 1] AS path,
  ['txt', 'md', 'vtt', 'eml', 'unsupported'][doc_id % 5 + 1] AS kind, coalesce(text, '') AS content, doc_id FROM documents)"""
_CUT = "CASE WHEN NOT regexp_matches(content, '\\S') THEN 'empty' WHEN kind = 'eml' AND NOT contains(replace(content, chr(13), ''), chr(10) || chr(10)) THEN 'no body' END"


@query(f"SELECT path, kind, sha256(content) AS hash, CAST(strlen(content) AS BIGINT) AS length, {_CUT} AS reason FROM {_FILES}")
def doc_scan(spark, sf):
    """Scanned documents: kind by extension, content hash, size, and why a file looks cut off."""
    return typed(file_rows(spark, sf)).select("path", "kind", "hash", "length", completeness("kind", "content").alias("reason"))


@query(f"SELECT min(path) AS path, arg_min(kind, path) AS kind, hash FROM (SELECT *, sha256(content) AS hash FROM {_FILES} WHERE doc_id % 9 <> 0) WHERE {_CUT} IS NULL GROUP BY hash")
def inbox_stream(spark, sf):
    """Files as they come in: temporary names ignored, cut-off files refused, content seen before dropped."""
    folder = _folder(spark)
    files = file_rows(spark, sf)
    files.write.parquet(f"{folder}/files")
    sink = jobs.Inbox(spark, folder)
    stream = spark.readStream.schema(files.schema).parquet(f"{folder}/files")
    sink.run(jobs.named_files(stream), f"{folder}/checkpoint")
    return sink.accepted().select("path", "kind", "hash")
