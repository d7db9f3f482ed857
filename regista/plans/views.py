"""Views of the given tables in the shapes of the register model, in Spark and (VIEW_SQL) in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-08-01"
REGISTERS = ["Decisions", "Actions", "Risks_Issues", "Config_Changes", "Open_Questions", "Milestones", "Entities", "Sources", "Uncertainty"]

# Sentences of v_notes: each kind of wording that the text rules look for, by o_orderkey % 24.
NOTES = [
    "I will mail the meter readings by friday",
    "Action: confirm the cutover date with the client",
    "Risk: the payroll migration may slip before month end",
    "Decision: keep the pump register in the new system",
    "Question: who signs off the valve drawings?",
    "Let me tick one more option in the settings now",
    "The valves were all checked by friday last year",
    "Please record that as a decision for the register",
    "The workshop is on monday 14th at 10:30 with the vendor",
    "We need to close the register by the end of the week",
    "It cannot export more than limited to fifty records",
    "password = hunter2secret and the run failed with 401 unauthorized",
    "See C:\\\\Users\\\\someone\\\\report.docx for the draft",
    "rate limit reached, try again later (429)",
    "codex: command not found, please install it",
    "unsupported model requested: model_not_found",
    "Milestone: go live on 2026-09-14 hard stop 2026-09-30",
    "Issue: duplicated contractor names in two registers",
    "Change: rename the Expired status to Lapsed",
    "w/c 2026-08-05 is the target for the pilot",
    "The rollout could be the couple of weeks after next friday",
    "token ghp_abcdefghijklmnopqrstuvwx leaked at https://user:pw@example.org/x",
    "This version requires a newer client, please upgrade",
    "Deliverable: signed test report [A-001] [R-002]",
]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores if they come in fewer partitions than those, as one small file does; large tables stay as they
    are. For work on texts that takes far longer than a shuffle of them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def pick(values: list[str], index: Column) -> Column:
    """The element of a short literal list at an index."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("\\\\", "\\").replace("'", "''") + "'" for v in values) + "]"


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """Register rows: a project is a nation, a row an order, its owner the customer."""
    return register_rows(read(spark, sf, "orders"), read(spark, sf, "customer"))


def register_rows(o: DataFrame, c: DataFrame) -> DataFrame:
    """Orders, streamed or not, with their customers as register rows."""
    key = F.col("o_orderkey")
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'Resolved' WHEN 'P' THEN 'pending ratification' ELSE 'open' END")
    severity = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END")
    owner = F.expr("CASE o_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Consultant' WHEN 2 THEN 'TBC.' ELSE c_name END")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("int").alias("project_id"), key.alias("external_id"), pick(REGISTERS, key % 9).alias("register_name"),
        F.concat_ws(" ", F.lit("Order"), key.cast("string"), "c_mktsegment").alias("title"), status.alias("status"), severity.alias("severity"), owner.alias("owner"),
        F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'almost certain' WHEN 1 THEN 'Likely' WHEN 2 THEN 'possible' WHEN 3 THEN 'unlikely' END").alias("likelihood"),
        (key % 11 == 0).alias("blocking"), F.to_date("o_orderdate").alias("created_on"),
        F.when(key % 4 != 3, F.date_add(F.to_date("o_orderdate"), (key % 60).cast("int"))).alias("due_date"),
        F.col("o_custkey").alias("source_id"), (key + 6).alias("related_id"), F.when(key % 13 == 0, key + 1).alias("supersedes_id"), F.round("o_totalprice", 2).alias("amount"),
    )


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence anchors: a row cites a segment of a source."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_suppkey").alias("source_id"), day.alias("seq"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_id"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The log of human events on register rows."""
    return event_rows(read(spark, sf, "events"))


def event_rows(e: DataFrame) -> DataFrame:
    """Rows of the event log, streamed or not, as human events."""
    return e.select(
        F.col("event_id").alias("event_seq"), F.col("ts").cast("timestamp").alias("occurred_at"), F.col("user_id").alias("row_id"),
        F.expr("CASE WHEN event_type = 'purchase' THEN element_at(array('complete','resolve','ratify','reject','park','reopen','close'), CAST(event_id % 7 + 1 AS INT)) WHEN event_type = 'error' THEN 'reaffirm' ELSE 'update' END").alias("verb"),
        F.expr("CASE WHEN event_type IN ('click','view') THEN element_at(array('status','owner','due_date','resolution','title','summary'), CAST(event_id % 6 + 1 AS INT)) END").alias("field"),
        F.expr("CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('v', get_json_object(props, '$.k')) END").alias("new_value"), F.col("value"), F.col("event_type"),
    )


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of sources: turns of conversations."""
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), (F.col("turn") + 1).alias("seq"), F.col("role").alias("speaker"), F.col("text"))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Short notes that hold every kind of wording the text rules look for."""
    key = F.col("o_orderkey")
    note = pick([n.replace("\\\\", "\\") for n in NOTES], key % len(NOTES))
    return read(spark, sf, "orders").select(key.alias("note_id"), F.col("o_custkey").alias("source_id"), F.to_date("o_orderdate").alias("event_date"), F.concat(note, F.when(key % 3 == 0, F.concat(F.lit(" ref "), key.cast("string"))).otherwise(F.lit(""))).alias("text"))


def doc_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Register rows with prose: documents, a project per language."""
    return read(spark, sf, "documents").select(F.col("lang").alias("project_id"), F.col("doc_id").alias("row_id"), "text", "source")


VIEW_SQL = {
    "v_rows": f"""SELECT CAST(c_nationkey AS INTEGER) AS project_id, o_orderkey AS external_id, {_quoted(REGISTERS)}[o_orderkey % 9 + 1] AS register_name,
  'Order ' || o_orderkey || ' ' || c_mktsegment AS title, CASE o_orderstatus WHEN 'F' THEN 'Resolved' WHEN 'P' THEN 'pending ratification' ELSE 'open' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END AS severity,
  CASE o_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Consultant' WHEN 2 THEN 'TBC.' ELSE c_name END AS owner,
  CASE o_orderkey % 5 WHEN 0 THEN 'almost certain' WHEN 1 THEN 'Likely' WHEN 2 THEN 'possible' WHEN 3 THEN 'unlikely' END AS likelihood,
  o_orderkey % 11 = 0 AS blocking, CAST(o_orderdate AS DATE) AS created_on,
  CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) END AS due_date,
  o_custkey AS source_id, o_orderkey + 6 AS related_id, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 1 END AS supersedes_id, round(o_totalprice, 2) AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_anchors": "SELECT l_orderkey AS row_id, l_suppkey AS source_id, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS seq, l_linenumber AS line_no, l_partkey AS part_id FROM lineitem",
    "v_events": """SELECT event_id AS event_seq, ts AS occurred_at, user_id AS row_id,
  CASE WHEN event_type = 'purchase' THEN ['complete','resolve','ratify','reject','park','reopen','close'][event_id % 7 + 1] WHEN event_type = 'error' THEN 'reaffirm' ELSE 'update' END AS verb,
  CASE WHEN event_type IN ('click','view') THEN ['status','owner','due_date','resolution','title','summary'][event_id % 6 + 1] END AS field,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'v' || json_extract_string(props, '$.k') END AS new_value, value, event_type FROM events""",
    "v_segments": "SELECT conv_id AS source_id, turn + 1 AS seq, role AS speaker, text FROM conversations",
    "v_notes": f"""SELECT o_orderkey AS note_id, o_custkey AS source_id, CAST(o_orderdate AS DATE) AS event_date,
  {_quoted(NOTES)}[o_orderkey % {len(NOTES)} + 1] || CASE WHEN o_orderkey % 3 = 0 THEN ' ref ' || o_orderkey ELSE '' END AS text FROM orders""",
    "v_docrows": "SELECT lang AS project_id, doc_id AS row_id, text, source FROM documents",
}
