"""Document formats over sources that Spark builds from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regista.plans import views
from regista.plans.registry import query
from regista.sources import files


def transcripts(spark, sf) -> DataFrame:
    """Conversations written as transcripts: a cue of 20 seconds a turn, the speaker as a voice tag, or before the text, or
    (every third turn) left to the open span before it."""
    stamp = lambda s: F.concat(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60), F.lit(".000"))
    s = views.segments(spark, sf).withColumn("at", (F.col("seq") - 1) * 20)
    line = F.regexp_replace("text", r"\s+", " ")
    said = F.when(F.col("seq") % 3 == 0, line).otherwise(F.concat(F.lit("<v "), "speaker", F.lit(">"), line))
    cue = F.concat(stamp(F.col("at")), F.lit(" --> "), stamp(F.col("at") + 20), F.lit("\n"), said)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", cue.alias("cue")))), lambda x: x["cue"])
    return s.groupBy("source_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(listed, "\n\n")).alias("text"))


_PLAIN = "trim(regexp_replace(" + "replace(" * 6 + "regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'))"


@query(f"SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS seq, (seq - 1) * 20000 AS start_ms, seq * 20000 AS end_ms, CASE WHEN seq % 3 = 0 THEN lag(speaker) OVER (PARTITION BY source_id ORDER BY seq) ELSE speaker END AS speaker, {_PLAIN} AS text FROM v_segments")
def vtt_segments(spark, sf):
    return files.vtt_segments(transcripts(spark, sf))


def letters(spark, sf) -> DataFrame:
    """Documents as e-mails: plain, base64 or quoted-printable by id."""
    d = views.read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_replace("text", r"[\r\n]+", "\n\n").alias("t"))
    k = F.col("doc_id") % 3
    code = F.when(k == 0, "base64").when(k == 1, "quoted-printable").otherwise("8bit")
    raw = F.encode("t", "UTF-8")
    body = F.when(k == 0, F.base64(raw)).when(k == 1, F.regexp_replace(F.hex(raw), "(..)", "=$1")).otherwise(F.col("t"))
    head = F.concat(F.lit("From: Someone <s"), F.col("doc_id").cast("string"), F.lit("@example.org>\nSubject: Letter\n "), F.col("doc_id").cast("string"), F.lit("\nContent-Transfer-Encoding: "), code, F.lit("\n\n"))
    return d.select(F.col("doc_id").alias("source_id"), F.concat(head, body).alias("text"))


@query("SELECT doc_id AS source_id, 1 + len(list_filter(string_split(regexp_replace(text, '[\\r\\n]+', chr(10), 'g'), chr(10)), lambda p: trim(p) <> '')) AS n_segments, 'Someone <s' || doc_id || '@example.org>' AS speaker, 'Letter ' || doc_id AS subject FROM documents WHERE text IS NOT NULL")
def eml_segments(spark, sf):
    """Segments, sender and subject of e-mails; the unfolded subject is their first segment."""
    s = files.mail_segments(letters(spark, sf))
    return s.groupBy("source_id").agg(F.count("*").alias("n_segments"), F.first("speaker").alias("speaker"), F.max(F.when(F.col("seq") == 1, F.col("text"))).alias("subject"))


@query("SELECT source_id, CASE source_id % 4 WHEN 0 THEN 'ends on a timing line' WHEN 1 THEN 'empty' END AS reason FROM (SELECT DISTINCT source_id FROM v_segments)")
def completeness(spark, sf):
    """Cut-off transcripts: every fourth ends on a timing line here, every fourth is empty."""
    t = transcripts(spark, sf)
    k = F.col("source_id") % 4
    text = F.when(k == 0, F.concat("text", F.lit("\n\n00:10:00.000 --> 00:10:20.000"))).when(k == 1, "").otherwise(F.col("text"))
    return t.select("source_id", F.lit("vtt").alias("kind"), F.encode(text, "UTF-8").alias("content")).select("source_id", files.completeness("kind", "content").alias("reason"))


@query("""SELECT doc_id || '.docx' AS path, k, CASE WHEN k = 0 THEN 'Heading1' ELSE '' END AS style, text FROM (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS k, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM documents) WHERE text <> ''""")
def docx_segments(spark, sf):
    """Paragraphs of Word files, built here from the documents, with their styles."""
    return files.docx_segments(files.docx_files(views.read(spark, sf, "documents"), "doc_id")).withColumn("k", F.col("k").cast("long"))
