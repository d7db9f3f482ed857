"""Scans, ingest, dedupe, upserts and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regista.operators.scoring import folded
from regista.plans import views
from regista.sources import imports
from regista.plans.registry import query


def upsert(snapshot: DataFrame, batch: DataFrame, keys: list[str], order: list[str], keep: list[str] = ()) -> DataFrame:
    """The snapshot after a batch: last writer wins by ``order``, columns in ``keep`` stay as first written."""
    values = [c for c in snapshot.columns if c not in keys]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("new"))
    old = snapshot.select(*keys, F.struct(*values).alias("old"))
    both = old.join(last, keys, "full")
    pick = lambda c: F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")) if c in keep else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in values])


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, in one aggregation."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("r")).select(*keys, "r.*")


@query("SELECT doc_id, lang, first_doc, doc_id <> first_doc AS duplicate FROM (SELECT doc_id, lang, first_value(doc_id) OVER (PARTITION BY lang, sha256(coalesce(text, '')) ORDER BY doc_id) AS first_doc FROM documents)")
def content_dedupe(spark, sf):
    """First arrival of each content in its project; later ones are marked."""
    d = views.read(spark, sf, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    first = d.groupBy("lang", "hash").agg(F.min("doc_id").alias("first_doc"))
    return d.join(first, ["lang", "hash"]).select("doc_id", "lang", "first_doc", (F.col("doc_id") != F.col("first_doc")).alias("duplicate"))


@query("""SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.value, o.value) AS value, coalesce(n.event_type, o.event_type) AS event_type, coalesce(o.first_id, n.event_id) AS first_id FROM
(SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type, min(event_id) AS first_id FROM events WHERE event_id % 3 <> 0 GROUP BY user_id) o FULL JOIN
(SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_id % 3 = 0 GROUP BY user_id) n ON o.user_id = n.user_id""")
def upsert_latest(spark, sf):
    e = views.read(spark, sf, "events")
    old = latest(e.where("event_id % 3 <> 0").select("user_id", "value", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "value", "event_type", "ts", "event_id")
    first = e.where("event_id % 3 <> 0").groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    snapshot = old.join(first, "user_id").select("user_id", "value", "event_type", "first_id", "ts")
    batch = e.where("event_id % 3 = 0").select("user_id", "value", "event_type", F.col("event_id").alias("first_id"), "ts")
    return upsert(snapshot, batch, ["user_id"], ["ts", "first_id"], keep=["first_id"]).drop("ts")


@query("""SELECT user_id, count(*) AS n_rows, count_if(k IS NULL OR k > 90) AS n_bad, count_if(k IS NULL OR k > 90) > 0.1 * count(*) AS failed, sum(CASE WHEN k <= 90 THEN k END) AS kept_sum FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id""")
def tolerant_ingest(spark, sf):
    """Rows with a bad payload are set aside with a reason; a batch with more than a tenth of them fails."""
    e = views.read(spark, sf, "events").withColumn("p", F.from_json("props", "k long"))
    e = e.withColumn("reason", F.when(F.col("p.k").isNull(), "unreadable").when(F.col("p.k") > 90, "out of range"))
    bad = F.col("reason").isNotNull()
    return e.groupBy("user_id").agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad"), (F.count_if(bad) > 0.1 * F.count("*")).alias("failed"), F.sum(F.when(~bad, F.col("p.k"))).alias("kept_sum"))


@query("SELECT user_id, event_type, event_id, sha256(props) AS hash, n_calls FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n_calls FROM events) WHERE r = 1")
def latest_per_call(spark, sf):
    e = views.read(spark, sf, "events").dropDuplicates(["event_id"])
    last = e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "props"), F.struct("ts", "event_id")).alias("r"), F.count("*").alias("n_calls"))
    return last.select("user_id", "event_type", "r.event_id", F.sha2("r.props", 256).alias("hash"), "n_calls")


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def calendar_range(spark, sf):
    return views.read(spark, sf, "events").where("ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-12'").select("event_id", "ts", "user_id").orderBy("ts", "event_id")


@query("SELECT event_id, ts, substring('message ' || props, 1, 12) AS preview FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 50")
def inbox_top50(spark, sf):
    e = views.read(spark, sf, "events").where("event_type = 'view'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return e.select("event_id", "ts", F.substring(F.concat(F.lit("message "), "props"), 1, 12).alias("preview"))


@query("SELECT CAST(ts AS DATE) AS batch, count(*) AS n_rows, count(DISTINCT user_id) AS n_keys, min(event_id) AS first_id, max(event_id) AS last_id, count_if(event_type = 'error') AS n_failed FROM events GROUP BY 1")
def sync_log(spark, sf):
    return views.read(spark, sf, "events").groupBy(F.to_date("ts").alias("batch")).agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_keys"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count_if(F.col("event_type") == "error").alias("n_failed"))


_EAV = ["title", "status", "severity", "owner", "likelihood"]


def exploded(rows: DataFrame) -> DataFrame:
    """(external_id, field, value_json, normalised) of every field of the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in _EAV])
    long = rows.select("external_id", F.inline(pairs))
    return long.select("external_id", "field", F.coalesce(F.concat(F.lit('"'), "value", F.lit('"')), F.lit("null")).alias("value_json"), folded("value").alias("normalised"))


@query(" UNION ALL ".join(f"SELECT external_id, '{c}' AS field, coalesce('\"' || {c} || '\"', 'null') AS value_json, lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))) AS normalised FROM v_rows" for c in _EAV))
def eav_fields(spark, sf):
    return exploded(views.rows(spark, sf))


_KIND = "CASE l_returnflag WHEN 'A' THEN 'actions' WHEN 'R' THEN 'risksIssues' ELSE 'milestones' END"


def portfolio_documents(spark, sf) -> DataFrame:
    """Orders written as portfolio documents, one project each, its lines as actions, risks and milestones."""
    li = views.read(spark, sf, "lineitem")
    record = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"), F.col("l_linestatus").alias("status"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("dueDate"))
    of = lambda name: F.collect_list(F.when(F.expr(_KIND) == name, record)).alias(name)
    lists = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[of(n) for n in ("actions", "risksIssues", "milestones")])
    o = views.read(spark, sf, "orders").join(lists, "o_orderkey", "left")
    project = F.struct(F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("code"), "actions", "risksIssues", "milestones")
    return o.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.array(project).alias("projects"))).alias("text"))


@query(f"""SELECT 'projects' AS entity, 'P' || o_orderkey AS project_id, 'P' || o_orderkey AS id, o_orderpriority AS title, NULL AS status, NULL AS due_on FROM orders
UNION ALL SELECT {_KIND}, 'P' || l_orderkey, l_orderkey || '-' || l_linenumber, 'Part ' || l_partkey, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def import_entities(spark, sf):
    """Portfolio documents taken apart: one row per record of each entity, with its project."""
    return imports.portfolio_records(portfolio_documents(spark, sf))


def packet_documents(spark, sf) -> DataFrame:
    """Orders written as register packets: odd lines as a plain list of decisions, even ones as an object of actions, under
    three names of the id (none for small quantities), and a register nobody knows. Orders of high value arrive twice;
    those in progress name another code than that of the project they are sent to."""
    li = views.read(spark, sf, "lineitem")
    ident = F.when(F.col("l_quantity") >= 5, (F.col("l_partkey") % 4).cast("string"))
    names = ("ID", "External-ID", "ref")
    row = F.struct(*[F.when(F.col("l_linenumber") % 3 == k, ident).alias(n) for k, n in enumerate(names)], F.col("l_linestatus").alias("status"))
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.when(F.col("l_linenumber") % 2 == 1, row)).alias("odd"), F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, row)).alias("even"))
    o = views.read(spark, sf, "orders").join(lines, "o_orderkey", "left")
    code = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    named = F.when(F.col("o_orderstatus") == "P", "elsewhere").otherwise(code)
    text = F.to_json(F.struct(named.alias("project_code"), F.col("o_orderkey").alias("number"), F.col("odd").alias("Decisions"), F.struct(F.col("even").alias("rows")).alias("Actions"), F.col("odd").alias("Unknown")))
    key = F.col("o_orderkey").cast("string")
    sent = F.when(F.col("o_totalprice") > 250000, F.array(key, F.concat(key, F.lit("-again")))).otherwise(F.array(key))
    return o.select(F.explode(sent).alias("packet"), code.alias("code"), text.alias("text"))


@query("""WITH sent AS (
  SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS packet, CASE WHEN o_orderstatus = 'P' THEN 'code mismatch' END AS refused FROM orders
  UNION ALL SELECT o_orderkey, o_orderkey || '-again', 'same content' FROM orders WHERE o_totalprice > 250000),
line AS (
  SELECT packet, CASE WHEN l_linenumber % 2 = 1 THEN 'Decisions' ELSE 'Actions' END AS register_name, CASE WHEN l_quantity >= 5 THEN CAST(l_partkey % 4 AS VARCHAR) END AS external_id
  FROM sent JOIN lineitem ON l_orderkey = o_orderkey WHERE refused IS NULL)
SELECT packet, register_name, external_id, CASE WHEN external_id IS NULL THEN 'missing id' WHEN count(*) OVER (PARTITION BY packet, register_name, external_id) > 1 THEN 'repeated id' END AS reason FROM line
UNION ALL SELECT packet, NULL, NULL, refused FROM sent WHERE refused IS NOT NULL""")
def register_import(spark, sf):
    """Register packets taken apart, with what is refused and why."""
    return imports.imported(packet_documents(spark, sf), views.REGISTERS)
