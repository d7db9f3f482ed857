"""Portfolio answers: what needs attention, summaries, counts, freshness, reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regista.operators.ranking import placed
from regista.operators.substring import SubstringIndex
from regista.plans import state, views
from regista.plans.registry import query
from regista.plans.views import VIEW_SQL

AS_OF = state.AS_OF

# Which open records of each register reach the queue, with the reason given.
RULES = [
    ("action", "register_name = 'Actions' AND ownership <> 'customer'", "Your action is required."),
    ("risk-issue", "register_name = 'Risks_Issues' AND severity_label IN ('high', 'critical')", "Risk needs your intervention."),
    ("decision", "register_name = 'Decisions' AND ownership <> 'customer'", "Decision awaits you."),
    ("open-question", "register_name = 'Open_Questions' AND blocking", "A question blocks the work."),
    ("milestone", "register_name = 'Milestones' AND due_days <= 14", "A milestone is close."),
    ("change", "register_name = 'Config_Changes' AND conflict", "A change is contested."),
    ("uncertainty", "register_name = 'Uncertainty' AND band IN ('Now', 'Soon')", "Something is uncertain."),
    ("source", "register_name = 'Sources' AND stale AND due_days < 0", "A source is stale."),
    ("entity", "register_name = 'Entities' AND supersedes_id IS NOT NULL", "An entity was superseded."),
]
_URGENCY = "CASE WHEN severity_label = 'critical' THEN 'now' WHEN due_days < 0 THEN 'now' WHEN due_days <= 3 THEN 'soon' ELSE 'watch' END"
VIEW_SQL["v_attention"] = " UNION ALL ".join(f"SELECT '{n}' AS entity, project_id, external_id, '{r}' AS reason, {_URGENCY} AS urgency, due_date FROM v_scored WHERE NOT closed AND {w}" for n, w, r in RULES)


def urgency(due_days, forced):
    return F.when(forced, "now").when(due_days < 0, "now").when(due_days <= 3, "soon").otherwise("watch")


def attention(spark, sf) -> DataFrame:
    """The attention queue in one scan: a row per inclusion rule that holds (a register has one rule)."""
    s = state.scored(spark, sf).where("NOT closed")
    hits = F.array(*[F.when(F.expr(w), F.struct(F.lit(n).alias("entity"), F.lit(r).alias("reason"))) for n, w, r in RULES])
    s = s.withColumn("urgency", urgency(F.col("due_days"), F.col("severity_label") == "critical"))
    return s.select("project_id", "external_id", "urgency", "due_date", F.inline(F.filter(hits, lambda x: x.isNotNull())))


@query("SELECT entity, project_id, external_id, reason, urgency, due_date FROM v_attention")
def attention_queue(spark, sf):
    return attention(spark, sf)


@query(f"SELECT external_id, {_URGENCY} AS urgency FROM v_scored", name="urgency")
def urgency_of_rows(spark, sf):
    return state.scored(spark, sf).select("external_id", urgency(F.col("due_days"), F.col("severity_label") == "critical").alias("urgency"))


@query("SELECT project_id, external_id, row_number() OVER (PARTITION BY project_id ORDER BY CASE urgency WHEN 'now' THEN 0 WHEN 'soon' THEN 1 ELSE 2 END, due_date NULLS LAST, external_id) AS place FROM v_attention")
def attention_order(spark, sf):
    rank = F.when(F.col("urgency") == "now", 0).when(F.col("urgency") == "soon", 1).otherwise(2)
    rows = attention(spark, sf).select("project_id", "external_id", "due_date", rank.alias("rank"))
    return placed(rows, ["project_id"], [F.col("rank"), F.col("due_date").asc_nulls_last(), F.col("external_id")], "place").select("project_id", "external_id", "place")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 24 HOUR AND value > 5")
def overdue_verification(spark, sf):
    """Verifications (here: errors worth more than five) pending for more than a day as of a given instant."""
    e = views.read(spark, sf, "events")
    return e.where("event_type = 'error' AND value > 5 AND ts < TIMESTAMP_NTZ '2024-01-15 00:00:00' - INTERVAL 24 HOURS").select("event_id", "user_id")


@query("SELECT n.n_nationkey AS project_id, n.n_name AS name, m.next_milestone, coalesce(a.n_attention, 0) AS n_attention, coalesce(s.n_open_high, 0) AS n_open_high FROM nation n LEFT JOIN (SELECT project_id, arg_min(external_id, (due_date, external_id)) AS next_milestone FROM v_scored WHERE register_name = 'Milestones' AND NOT closed AND due_days >= 0 GROUP BY 1) m ON m.project_id = n.n_nationkey LEFT JOIN (SELECT project_id, count(*) AS n_attention FROM v_attention GROUP BY 1) a ON a.project_id = n.n_nationkey LEFT JOIN (SELECT project_id, count_if(NOT closed AND severity_label IN ('high', 'critical')) AS n_open_high FROM v_scored GROUP BY 1) s ON s.project_id = n.n_nationkey")
def project_summary(spark, sf):
    s = state.scored(spark, sf)
    milestone = (F.col("register_name") == "Milestones") & ~F.col("closed") & (F.col("due_days") >= 0)
    g = s.groupBy("project_id").agg(F.min_by(F.when(milestone, F.col("external_id")), F.when(milestone, F.struct("due_date", "external_id"))).alias("next_milestone"), F.count_if(~F.col("closed") & F.col("severity_label").isin("high", "critical")).alias("n_open_high"))
    a = attention(spark, sf).groupBy("project_id").agg(F.count("*").alias("n_attention"))
    n = views.read(spark, sf, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    return n.join(g, "project_id", "left").join(a, "project_id", "left").na.fill(0, ["n_attention", "n_open_high"])


@query("SELECT count(DISTINCT project_id) AS projects, count_if(NOT closed AND register_name = 'Actions') AS open_actions, count_if(NOT closed AND severity_label IN ('high', 'critical')) AS open_high, count_if(NOT closed AND due_days < 0) AS overdue, count_if(NOT closed AND blocking) AS blocking, count_if(NOT closed AND ownership = 'unowned') AS unowned FROM v_scored")
def portfolio_counts(spark, sf):
    open_ = ~F.col("closed")
    n = lambda c, name: F.count_if(open_ & c).alias(name)
    return state.scored(spark, sf).agg(
        F.count_distinct("project_id").alias("projects"), n(F.col("register_name") == "Actions", "open_actions"), n(F.col("severity_label").isin("high", "critical"), "open_high"),
        n(F.coalesce(F.col("due_days") < 0, F.lit(False)), "overdue"), n(F.col("blocking"), "blocking"), n(F.col("ownership") == "unowned", "unowned"),
    )


@query("SELECT event_id, ts, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 8")
def latest_activity(spark, sf):
    return views.read(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(8).select("event_id", "ts", "event_type", "user_id")


@query(f"SELECT o_custkey AS source_id, CAST(date_diff('hour', CAST(max(o_orderdate) AS TIMESTAMP), TIMESTAMP '{AS_OF}') AS BIGINT) AS hours, date_diff('hour', CAST(max(o_orderdate) AS TIMESTAMP), TIMESTAMP '{AS_OF}') > 72 AS stale FROM orders WHERE o_orderdate <= TIMESTAMP '{AS_OF}' GROUP BY o_custkey")
def freshness(spark, sf):
    at = F.lit(AS_OF).cast("timestamp")
    o = views.read(spark, sf, "orders").where(F.col("o_orderdate") <= at.cast("timestamp_ntz")).groupBy(F.col("o_custkey").alias("source_id")).agg(F.max("o_orderdate").alias("last"))
    hours = F.floor((at.cast("long") - F.col("last").cast("timestamp").cast("long")) / 3600)
    return o.select("source_id", hours.alias("hours"), (hours > 72).alias("stale"))


@query("SELECT project_id, external_id, severity, row_number() OVER (PARTITION BY project_id ORDER BY severity DESC NULLS LAST, external_id) AS lexical_place, row_number() OVER (PARTITION BY project_id ORDER BY CASE lower(severity) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, external_id) AS ranked_place FROM v_rows WHERE register_name = 'Risks_Issues'")
def entity_reads(spark, sf):
    """The stored reading order of risks (severity as text, descending) and the order by rank."""
    r = views.rows(spark, sf).where("register_name = 'Risks_Issues'")
    low = F.lower("severity")
    rank = F.when(low == "critical", 0).when(low == "high", 1).when(low == "medium", 2).when(low == "low", 3).otherwise(4)
    r = r.select("project_id", "external_id", "severity", rank.alias("rank"))
    r = placed(r, ["project_id"], [F.col("severity").desc_nulls_last(), F.col("external_id")], "lexical_place")
    return placed(r, ["project_id"], [F.col("rank"), F.col("external_id")], "ranked_place").drop("rank")


VIEW_SQL["v_searched"] = """SELECT s.project_id, s.register_name, s.external_id, s.title, s.status, s.due_date,
  lower(s.external_id || ' ' || s.title || ' ' || coalesce(s.severity, '') || ' ' || coalesce(s.status, '') || ' SRC-' || s.source_id || ' ' || coalesce('segment ' || a.seq, '')) AS haystack
FROM v_state s LEFT JOIN (SELECT row_id, min(seq) AS seq FROM v_anchors GROUP BY row_id) a ON a.row_id = s.external_id"""


def searched(spark, sf) -> DataFrame:
    """Current rows with the text that a search looks in: id, title, summary (here the severity), current status, source and
    first anchor."""
    s = state.current(spark, sf)
    first = views.anchors(spark, sf).groupBy("row_id").agg(F.min("seq").alias("seq"))
    j = s.join(first, F.col("row_id") == F.col("external_id"), "left")
    said = F.concat(F.col("external_id").cast("string"), F.lit(" "), "title", F.lit(" "), F.coalesce("severity", F.lit("")), F.lit(" "), F.coalesce("status", F.lit("")), F.lit(" SRC-"), F.col("source_id").cast("string"), F.lit(" "), F.coalesce(F.concat(F.lit("segment "), F.col("seq").cast("string")), F.lit("")))
    return j.select("project_id", "register_name", "external_id", "title", "status", "due_date", F.lower(said).alias("haystack"))


#: What the registered search asks for: part of an id and of a segment's field, a status, and a sort key (id, title or status).
TERM, STATUS, SORT = "7 machinery", "open", "title"


@query(f"""SELECT register_name, external_id, title, status, due_date, row_number() OVER (PARTITION BY register_name ORDER BY {SORT}, external_id) AS place
FROM v_searched WHERE contains(haystack, '{TERM}') AND status = '{STATUS}'""")
def register_search(spark, sf):
    """Rows that hold a text in any of six fields, case aside, by their postings; of one status, and their place by the sort key
    in their register."""
    index = SubstringIndex(searched(spark, sf), ["register_name", "external_id", "title", "status", "due_date"], "haystack")
    found = index.search(TERM).where(F.col("status") == STATUS)
    key = {"id": "external_id", "title": "title", "status": "status"}[SORT]
    out = placed(found, ["register_name"], [F.col(key), F.col("external_id")], "place")
    return out.select("register_name", "external_id", "title", "status", "due_date", F.col("place").cast("long").alias("place"))


@query("SELECT register_name, status, count(*) AS n_rows, row_number() OVER (PARTITION BY register_name ORDER BY status) AS place FROM v_searched WHERE status <> '' GROUP BY register_name, status")
def register_statuses(spark, sf):
    """The statuses that a register's rows have now, in order, for its filter."""
    n = searched(spark, sf).where("status <> ''").groupBy("register_name", "status").agg(F.count("*").alias("n_rows"))
    return placed(n, ["register_name"], [F.col("status")], "place").withColumn("place", F.col("place").cast("long"))


@query("SELECT s.external_id, s.status, coalesce(a.n_anchors, 0) AS n_anchors, a.first_anchor, a.anchors, s.n_events, e.last_verb, s.score FROM v_scored s LEFT JOIN (SELECT row_id, count(*) AS n_anchors, arg_min(source_id, (line_no, source_id, seq)) AS first_anchor, string_agg(source_id || ':' || seq, ',' ORDER BY line_no, source_id, seq) AS anchors FROM v_anchors GROUP BY row_id) a ON a.row_id = s.external_id LEFT JOIN (SELECT row_id, arg_max(verb, (occurred_at, event_seq)) AS last_verb FROM v_events GROUP BY row_id) e ON e.row_id = s.external_id")
def row_dossier(spark, sf):
    """A row with its ordered anchors, events, state and score, in place of a query per row."""
    a = views.anchors(spark, sf).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "source_id", "seq"))).alias("l"))
    a = a.select(F.col("row_id").alias("external_id"), F.size("l").cast("long").alias("n_anchors"), F.col("l")[0]["source_id"].alias("first_anchor"), F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["source_id"].cast("string"), x["seq"].cast("string"))), ",").alias("anchors"))
    e = views.events(spark, sf).groupBy(F.col("row_id").alias("external_id")).agg(F.max_by("verb", F.struct("occurred_at", "event_seq")).alias("last_verb"))
    s = state.scored(spark, sf).select("external_id", "status", "n_events", "score")
    return s.join(a, "external_id", "left").join(e, "external_id", "left").na.fill(0, ["n_anchors"])


@query("SELECT s.source_id, s.n_segments, CAST(ceil(s.n_segments / 4.0) AS BIGINT) AS n_windows, coalesce(e.n_runs, 0) AS n_runs, round(coalesce(e.tokens, 0), 4) AS tokens FROM (SELECT source_id, count(*) AS n_segments FROM v_segments GROUP BY 1) s LEFT JOIN (SELECT user_id, count(*) AS n_runs, sum(value) AS tokens FROM events GROUP BY 1) e ON e.user_id = s.source_id")
def source_summary(spark, sf):
    s = views.segments(spark, sf).groupBy("source_id").agg(F.count("*").alias("n_segments"))
    e = views.read(spark, sf, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.count("*").alias("n_runs"), F.sum("value").alias("t"))
    j = s.join(e, "source_id", "left")
    return j.select("source_id", "n_segments", F.ceil(F.col("n_segments") / 4).alias("n_windows"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.round(F.coalesce("t", F.lit(0.0)), 4).alias("tokens"))


@query("SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'stalled' END AS reason FROM events WHERE event_type = 'error' OR (event_type = 'signup' AND value < 1)")
def source_alerts(spark, sf):
    e = views.read(spark, sf, "events").where("event_type = 'error' OR (event_type = 'signup' AND value < 1)")
    return e.select("event_id", "user_id", F.when(F.col("event_type") == "error", "failed").otherwise("stalled").alias("reason"))


@query("SELECT register_name, op, count(*) AS n_ops FROM v_ops JOIN v_rows ON target_id = external_id GROUP BY ROLLUP (register_name, op)")
def op_counts(spark, sf):
    j = state.ops(spark, sf).join(views.rows(spark, sf).select("external_id", "register_name"), F.col("target_id") == F.col("external_id"))
    return j.rollup("register_name", "op").agg(F.count("*").alias("n_ops"))
