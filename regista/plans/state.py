"""Event replay, current state, scores, bands and operational tables."""

from __future__ import annotations

import copy
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regista.operators import scoring
from regista.operators.scoring import folded
from regista.plans import views
from regista.plans.registry import query
from regista.plans.store import materialize, shared_dir
from regista.plans.views import VIEW_SQL
from regista.sources import sinks

AS_OF = views.AS_OF
OPS = ["add", "update", "resolve", "supersede", "reaffirm", "conflict", "possible_duplicate"]

_UNOWNED = "(" + ", ".join(f"'{u}'" for u in scoring.UNOWNED) + ")"
_CLOSED = "(" + ", ".join(f"'{c}'" for c in scoring.CLOSED) + ")"


def _fold(c: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"


def _unowned(c: str) -> str:
    return f"(regexp_replace({_fold(c)}, '[.!]+$', '') IN {_UNOWNED})"


def _ownership(c: str) -> str:
    return f"CASE WHEN {_unowned(c)} THEN 'unowned' WHEN {_fold(c)} = 'consultant' OR contains({_fold(c)}, 'implementation consultant') THEN 'consultant' ELSE 'customer' END"


_VERB = "CASE verb WHEN 'complete' THEN 'completed' WHEN 'close' THEN 'resolved' WHEN 'resolve' THEN 'resolved' WHEN 'ratify' THEN 'ratified' WHEN 'reject' THEN 'rejected' WHEN 'park' THEN 'parked' WHEN 'reopen' THEN 'open' END"

VIEW_SQL["v_ops"] = f"SELECT l_suppkey AS changeset_id, l_orderkey AS target_id, l_linenumber AS line_no, {views._quoted(OPS)}[(l_orderkey + l_linenumber) % 7 + 1] AS op, CASE l_returnflag WHEN 'N' THEN 'pending' WHEN 'A' THEN 'accepted' ELSE 'rejected' END AS op_status, l_quantity, CAST(l_shipdate AS DATE) AS op_date FROM lineitem"
VIEW_SQL["v_verbs"] = f"SELECT *, {_VERB} AS verb_status FROM v_events"
VIEW_SQL["v_replayed"] = f"""SELECT row_id,
  max(CASE WHEN rs = 1 THEN coalesce(verb_status, new_value) END) AS status, bool_or(is_status) AS has_status,
  max(CASE WHEN ro = 1 AND NOT {_unowned("new_value")} THEN new_value END) AS owner, bool_or(is_owner) AS has_owner,
  max(CASE WHEN rd = 1 THEN new_value END) AS due_date, bool_or(is_due) AS has_due,
  max(CASE WHEN rr = 1 THEN new_value END) AS resolution, bool_or(is_res) AS has_resolution, max(occurred_at) AS last_event_at, count(*) AS n_events
  FROM (SELECT *, CASE WHEN is_status THEN row_number() OVER (PARTITION BY row_id, is_status ORDER BY occurred_at DESC, event_seq DESC) END AS rs,
    CASE WHEN is_owner THEN row_number() OVER (PARTITION BY row_id, is_owner ORDER BY occurred_at DESC, event_seq DESC) END AS ro,
    CASE WHEN is_due THEN row_number() OVER (PARTITION BY row_id, is_due ORDER BY occurred_at DESC, event_seq DESC) END AS rd,
    CASE WHEN is_res THEN row_number() OVER (PARTITION BY row_id, is_res ORDER BY occurred_at DESC, event_seq DESC) END AS rr
    FROM (SELECT *, verb_status IS NOT NULL OR coalesce(field = 'status', false) AS is_status, coalesce(field = 'owner', false) AS is_owner, coalesce(field = 'due_date', false) AS is_due, coalesce(field = 'resolution', false) AS is_res FROM v_verbs))
  GROUP BY row_id"""
VIEW_SQL["v_state"] = f"""SELECT r.project_id, r.external_id, r.register_name, r.title, r.severity, r.likelihood, r.blocking, r.created_on, r.source_id, r.related_id, r.supersedes_id, r.amount,
  CASE WHEN coalesce(e.has_status, false) THEN e.status ELSE r.status END AS status,
  CASE WHEN coalesce(e.has_owner, false) THEN e.owner WHEN {_unowned("r.owner")} THEN NULL ELSE r.owner END AS owner,
  CASE WHEN coalesce(e.has_due, false) THEN try_cast(e.due_date AS DATE) ELSE r.due_date END AS due_date, e.resolution, e.last_event_at, coalesce(e.n_events, 0) AS n_events
  FROM v_rows r LEFT JOIN v_replayed e ON r.external_id = e.row_id"""
VIEW_SQL["v_facts"] = """SELECT s.*, coalesce(s.source_id = l.latest_source, false) AS latest, s.supersedes_id IS NOT NULL AS superseding,
  EXISTS (SELECT 1 FROM v_ops o WHERE o.target_id = s.external_id AND o.op = 'conflict' AND o.op_status = 'pending') AS conflict,
  EXISTS (SELECT 1 FROM v_rows u WHERE u.external_id = s.related_id AND u.project_id = s.project_id AND u.register_name = 'Uncertainty' AND NOT contains(lower(u.status), 'resolved')) AS uncertain
  FROM v_state s JOIN (SELECT project_id, arg_max(source_id, (created_on, source_id)) AS latest_source FROM v_rows GROUP BY project_id) l ON s.project_id = l.project_id"""


def _case(of: str, table: dict[str, int]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


def scored_sql(w: dict, source: str = "v_facts") -> str:
    f, b, u = w["flags"], w["bands"], w["urgency"]
    return f"""SELECT *, CASE WHEN closed THEN 'Reference' WHEN blocking OR conflict OR coalesce(due_days < 0, false) THEN 'Now' WHEN due_days <= 7 OR severity_label IN ('critical', 'high') THEN 'Soon'
  WHEN score >= {b["now"]} THEN 'Now' WHEN score >= {b["soon"]} THEN 'Soon' WHEN score >= {b["watch"]} THEN 'Watch' ELSE 'Reference' END AS band FROM (
  SELECT *, CAST({_case("register_name", w["register"])} + {_case("severity_label", w["severity"])} + {_case(f"replace({_fold('likelihood')}, ' ', '-')", w["likelihood"])}
    + CASE WHEN blocking THEN {f["blocking"]} ELSE 0 END + CASE WHEN due_days < 0 THEN {u["overdue"]} WHEN due_days <= 3 THEN {u["three"]} WHEN due_days <= 7 THEN {u["seven"]} WHEN due_days <= 14 THEN {u["fourteen"]} ELSE 0 END
    + CASE ownership WHEN 'unowned' THEN 0 WHEN 'consultant' THEN {w["ownership"]["consultant"]} ELSE {w["ownership"]["customer"]} END
    + CASE WHEN latest THEN {f["latest"]} ELSE 0 END + CASE WHEN superseding THEN {f["supersession"]} ELSE 0 END + CASE WHEN conflict THEN {f["conflict"]} ELSE 0 END
    + CASE WHEN uncertain THEN {f["uncertainty"]} ELSE 0 END + CASE WHEN stale THEN {f["staleness"]} ELSE 0 END + CASE WHEN closed THEN {f["closure"]} ELSE 0 END AS INTEGER) AS score FROM (
  SELECT *, CAST(due_date - DATE '{AS_OF}' AS INTEGER) AS due_days, {_fold("status")} IN {_CLOSED} AS closed, {_fold("severity")} AS severity_label, {_ownership("owner")} AS ownership,
    NOT ({_fold("status")} IN {_CLOSED}) AND n_events = 0 AND DATE '{AS_OF}' - created_on > {w["stale_days"]} AS stale FROM {source}))"""


VIEW_SQL["v_scored"] = scored_sql(scoring.WEIGHTS)


def ops(spark: SparkSession, sf: str) -> DataFrame:
    """Operations of changesets on rows."""
    li = views.read(spark, sf, "lineitem")
    status = F.expr("CASE l_returnflag WHEN 'N' THEN 'pending' WHEN 'A' THEN 'accepted' ELSE 'rejected' END")
    return li.select(
        F.col("l_suppkey").alias("changeset_id"), F.col("l_orderkey").alias("target_id"), F.col("l_linenumber").alias("line_no"),
        views.pick(OPS, (F.col("l_orderkey") + F.col("l_linenumber")) % 7).alias("op"), status.alias("op_status"), "l_quantity", F.to_date("l_shipdate").alias("op_date"),
    )


def as_of():
    return F.lit(AS_OF).cast("date")


def current(spark: SparkSession, sf: str) -> DataFrame:
    """Register rows in their current state."""
    return with_events(views.rows(spark, sf), views.events(spark, sf))


def with_events(r: DataFrame, events: DataFrame) -> DataFrame:
    """Rows after the events on them: events win over what the row says."""
    e = scoring.replay(events)
    joined = r.alias("r").join(e.alias("e"), F.col("r.external_id") == F.col("e.row_id"), "left")
    own = F.when(~scoring.is_unowned("r.owner"), F.col("r.owner"))
    either = lambda field, otherwise: F.when(F.col(f"e.{field}").isNotNull(), F.col(f"e.{field}.v")).otherwise(otherwise)
    keep = [c for c in r.columns if c not in ("status", "owner", "due_date")]
    due = F.when(F.col("e.due_date").isNotNull(), F.expr("try_to_date(e.due_date.v)")).otherwise(F.col("r.due_date"))
    return joined.select(
        *[F.col(f"r.{c}") for c in keep], either("status", F.col("r.status")).alias("status"), either("owner", own).alias("owner"), due.alias("due_date"),
        F.col("e.resolution.v").alias("resolution"), "last_event_at", F.coalesce("n_events", F.lit(0)).alias("n_events"),
    )


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """The current state with the flags that the score needs."""
    r = materialize(views.rows(spark, sf), "rows")  # read four times below
    s = with_events(r, views.events(spark, sf))
    newest = r.groupBy("project_id").agg(F.max_by("source_id", F.struct("created_on", "source_id")).alias("latest_source"))
    pending = ops(spark, sf).where("op = 'conflict' AND op_status = 'pending'").select(F.col("target_id").alias("external_id"), F.lit(True).alias("conflict")).distinct()
    open_ = r.where("register_name = 'Uncertainty'").where(~F.lower("status").contains("resolved")).select("project_id", F.col("external_id").alias("related_id"), F.lit(True).alias("uncertain"))
    out = s.join(newest, "project_id").join(pending, "external_id", "left").join(open_, ["project_id", "related_id"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumns({"latest": flag(F.col("source_id") == F.col("latest_source")), "superseding": F.col("supersedes_id").isNotNull(), "conflict": flag(F.col("conflict")), "uncertain": flag(F.col("uncertain"))}).drop("latest_source")


def scored(spark: SparkSession, sf: str, weights: dict = scoring.WEIGHTS) -> DataFrame:
    return scoring.score(facts(spark, sf), as_of(), weights)


@query("SELECT row_id, status, owner, due_date, resolution, has_status, has_owner, has_due, has_resolution, n_events FROM v_replayed")
def replay_state(spark, sf):
    return asserted(scoring.replay(views.events(spark, sf)))


def asserted(e: DataFrame) -> DataFrame:
    """A replay's values, and which of them were asserted at all."""
    have = {"has_status": "status", "has_owner": "owner", "has_due": "due_date", "has_resolution": "resolution"}
    return e.select("row_id", *[F.col(c)["v"].alias(c) for c in have.values()], *[F.col(c).isNotNull().alias(n) for n, c in have.items()], "n_events")


@query("""SELECT r.external_id, coalesce(t.new_value, r.title) AS title, s.new_value AS summary, t.row_id IS NOT NULL AS title_corrected, s.row_id IS NOT NULL AS summary_corrected FROM v_rows r
LEFT JOIN (SELECT row_id, arg_max(new_value, (occurred_at, event_seq)) AS new_value FROM v_events WHERE field = 'title' AND new_value IS NOT NULL GROUP BY row_id) t ON r.external_id = t.row_id
LEFT JOIN (SELECT row_id, arg_max(new_value, (occurred_at, event_seq)) AS new_value FROM v_events WHERE field = 'summary' AND new_value IS NOT NULL GROUP BY row_id) s ON r.external_id = s.row_id""")
def corrections(spark, sf):
    """Latest human correction of title and summary; the raw row is never rewritten, a null correction is refused."""
    e = views.events(spark, sf).where("field IN ('title', 'summary') AND new_value IS NOT NULL")
    last = e.groupBy("row_id").agg(*[scoring.last_by(F.col("new_value"), F.col("field") == f, "occurred_at", "event_seq").alias(f"new_{f}") for f in ("title", "summary")])
    out = views.rows(spark, sf).join(last, F.col("external_id") == F.col("row_id"), "left")
    return out.select("external_id", F.coalesce("new_title.v", "title").alias("title"), F.col("new_summary.v").alias("summary"), F.col("new_title").isNotNull().alias("title_corrected"), F.col("new_summary").isNotNull().alias("summary_corrected"))


@query("SELECT external_id, due_date, CASE WHEN coalesce(has_due, false) THEN 'event' WHEN s.due_date IS NOT NULL THEN 'row' ELSE 'none' END AS due_source FROM v_state s LEFT JOIN (SELECT row_id, has_due FROM v_replayed) e ON external_id = row_id")
def due_projection(spark, sf):
    e = scoring.replay(views.events(spark, sf)).select("row_id", F.col("due_date").isNotNull().alias("has_due"))
    s = current(spark, sf).join(e, F.col("external_id") == F.col("row_id"), "left")
    source = F.when(F.coalesce("has_due", F.lit(False)), "event").when(F.col("due_date").isNotNull(), "row").otherwise("none")
    return s.select("external_id", "due_date", source.alias("due_source"))


@query("SELECT project_id, external_id, register_name, severity_label, ownership, due_days, closed, stale, latest, superseding, conflict, uncertain, score FROM v_scored")
def importance_score(spark, sf):
    return scored(spark, sf).select("project_id", "external_id", "register_name", "severity_label", "ownership", "due_days", "closed", "stale", "latest", "superseding", "conflict", "uncertain", "score")


@query("SELECT project_id, band, count(*) AS n_rows, min(score) AS least, max(score) AS most FROM v_scored GROUP BY project_id, band")
def importance_band(spark, sf):
    return scored(spark, sf).groupBy("project_id", "band").agg(F.count("*").alias("n_rows"), F.min("score").alias("least"), F.max("score").alias("most"))


@query("SELECT project_id, count(*) AS n_rows, count_if(latest) AS n_latest, count_if(superseding) AS n_superseding, count_if(conflict) AS n_conflict, count_if(uncertain) AS n_uncertain FROM v_facts GROUP BY project_id")
def score_facts(spark, sf):
    names = ("latest", "superseding", "conflict", "uncertain")
    return facts(spark, sf).groupBy("project_id").agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(n)).alias(f"n_{n}") for n in names])


EARLIER = copy.deepcopy(scoring.WEIGHTS) | {"bands": {"now": 100, "soon": 60, "watch": 30}}
VIEW_SQL["v_scored_earlier"] = scored_sql(EARLIER)


BROKEN = copy.deepcopy(scoring.WEIGHTS) | {"bands": {"now": 30, "soon": 60, "watch": 90}}
#: Versions of the weights, one of them active.
VERSIONS = [("current", True, scoring.WEIGHTS), ("earlier", False, EARLIER), ("broken", False, BROKEN)]


@query("""SELECT 'earlier' AS version, a.band AS band, b.band AS version_band, count(*) AS n_rows, count_if(a.band <> b.band) AS n_changed FROM v_scored a JOIN v_scored_earlier b USING (external_id) GROUP BY a.band, b.band
UNION ALL SELECT 'current', band, band, count(*), 0 FROM v_scored GROUP BY band""")
def rescore_versions(spark, sf):
    """Bands of all rows under every valid version of the weights against the active one, and how many change. The facts are
    computed once; a version with faults is left out, and none or several active ones are an error."""
    _, weights = scoring.active(VERSIONS)
    found = materialize(facts(spark, sf), "facts")
    now = scoring.score(found, as_of(), weights).select("external_id", F.col("band"))
    out = None
    for name, _, version in VERSIONS:
        if not scoring.faults(version):
            then = scoring.score(found, as_of(), version).select("external_id", F.col("band").alias("version_band"))
            j = now.join(then, "external_id").groupBy("band", "version_band").agg(F.count("*").alias("n_rows"), F.count_if(F.col("band") != F.col("version_band")).alias("n_changed"))
            j = j.select(F.lit(name).alias("version"), "band", "version_band", "n_rows", "n_changed")
            out = j if out is None else out.unionByName(j)
    return out


@query(f"SELECT project_id, {_ownership('owner')} AS ownership, count(*) AS n_rows FROM v_rows GROUP BY ALL")
def ownership(spark, sf):
    return views.rows(spark, sf).groupBy("project_id", scoring.ownership("owner").alias("ownership")).agg(F.count("*").alias("n_rows"))


# Wording of statuses in order of precedence, and what they map to.
DECISION = [("supersed", "superseded"), ("agreed-in-principle", "agreed-in-principle"), ("pending-ratification", "pending-ratification"), ("ratified", "ratified"), ("rejected|declined", "rejected"), ("parked|on-hold|deferred", "parked"), ("agreed", "agreed"), ("decid|resolv|closed|close$|complete|finalis|finaliz|signed-off|sign-off|approved", "decided"), ("propos|draft", "proposed"), ("await|open|pending|to-do|outstanding", "awaiting-user")]
MILESTONE = [("^(?:not-started)$", "not-started"), ("^(?:in-progress)$", "in-progress"), ("^(?:at-risk)$", "at-risk"), ("^(?:achieved)$", "achieved"), ("^(?:missed)$", "missed"), ("missed|breached|overdue|not-achieved|failed", "missed"), ("complete|achiev|delivered|done|resolved|closed", "achieved"), ("at-risk|slipp|delayed|late", "at-risk"), ("in-progress|underway|started|in-flight|ongoing", "in-progress"), ("not-started|open|planned|pending|scheduled|to-do|upcoming|forecast", "not-started")]


def mapped(value, table, otherwise):
    """(value, recognised) by the first pattern that the hyphenated wording matches."""
    wording, out, known = F.regexp_replace(folded(value), " ", "-"), F.lit(otherwise), F.lit(False)
    for pattern, to in reversed(table):
        out, known = F.when(wording.rlike(pattern), to).otherwise(out), F.when(wording.rlike(pattern), True).otherwise(known)
    return out, known


def _mapped_sql(c: str, table, otherwise: str) -> tuple[str, str]:
    wording = f"replace({_fold(c)}, ' ', '-')"
    cases = " ".join(f"WHEN regexp_matches({wording}, '{p}') THEN '{to}'" for p, to in table)
    return f"CASE {cases} ELSE '{otherwise}' END", "regexp_matches(" + wording + ", '" + "|".join(p for p, _ in table) + "')"


RISK = [("issue|problem|defect", "issue"), ("risk|threat", "risk")]
_R = _mapped_sql("kind_text", RISK, "risk")
VIEW_SQL["v_kinds"] = "SELECT s.*, n.text AS kind_text FROM v_state s LEFT JOIN v_notes n ON n.note_id = s.external_id"


def with_kind_text(spark, sf) -> DataFrame:
    """The current rows with the wording their kind is read from: the note of the row."""
    return current(spark, sf).join(views.notes(spark, sf).select(F.col("note_id").alias("external_id"), F.col("text").alias("kind_text")), "external_id", "left")


_D, _M = _mapped_sql("status", DECISION, "awaiting-user"), _mapped_sql("status", MILESTONE, "not-started")


@query(f"""SELECT status, severity, likelihood, {_D[0]} AS decision, {_D[1]} AS decision_known, {_M[0]} AS milestone, {_M[1]} AS milestone_known,
CASE WHEN {_fold("severity")} IN ('low','medium','high','critical') THEN {_fold("severity")} ELSE 'unknown' END AS severity_value, CASE WHEN replace({_fold("likelihood")}, ' ', '-') IN ('unlikely','possible','likely','almost-certain') THEN replace({_fold("likelihood")}, ' ', '-') END AS likelihood_value,
{_R[0]} AS kind, {_R[1]} AS kind_known, {_fold("severity")} IN ('', 'low', 'medium', 'high', 'critical') AS severity_known, replace({_fold("likelihood")}, ' ', '-') IN ('', 'unlikely', 'possible', 'likely', 'almost-certain') AS likelihood_known,
count(*) AS n_rows FROM v_kinds GROUP BY ALL""")
def status_map(spark, sf):
    d, m = mapped("status", DECISION, "awaiting-user"), mapped("status", MILESTONE, "not-started")
    sev, like = folded("severity"), F.regexp_replace(folded("likelihood"), " ", "-")
    cols = {"decision": d[0], "decision_known": d[1], "milestone": m[0], "milestone_known": m[1], "severity_value": F.when(sev.isin("low", "medium", "high", "critical"), sev).otherwise("unknown"), "likelihood_value": F.when(like.isin("unlikely", "possible", "likely", "almost-certain"), like)}
    kind = mapped("kind_text", RISK, "risk")
    cols |= {"kind": kind[0], "kind_known": kind[1], "severity_known": sev.isin("", "low", "medium", "high", "critical"), "likelihood_known": like.isin("", "unlikely", "possible", "likely", "almost-certain")}
    return with_kind_text(spark, sf).withColumns(cols).groupBy("status", "severity", "likelihood", *cols).agg(F.count("*").alias("n_rows"))


TABLES = {"Decisions": "decisions", "Actions": "actions", "Risks_Issues": "risks_issues", "Config_Changes": "changes", "Open_Questions": "open_questions", "Milestones": "milestones", "Sources": "project_sources"}
_TABLE = "CASE register_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TABLES.items()) + " END"


_UNREAD = f"CASE WHEN register_name = 'Decisions' AND NOT {_D[1]} OR register_name = 'Milestones' AND NOT {_M[1]} THEN coalesce(status, 'open') WHEN register_name = 'Risks_Issues' AND NOT {_R[1]} THEN 'type ' || kind_text END"


@query(f"""SELECT {_TABLE} AS table_name, project_id, external_id AS id, title,
  CASE WHEN register_name = 'Decisions' THEN {_D[0]} WHEN register_name = 'Milestones' THEN {_M[0]} WHEN register_name <> 'Sources' THEN coalesce(status, 'open') END AS status,
  CASE WHEN register_name <> 'Sources' THEN coalesce(owner, 'Unassigned') END AS owner,
  CASE register_name WHEN 'Milestones' THEN coalesce(due_date, DATE '9999-12-31') WHEN 'Sources' THEN NULL ELSE due_date END AS due_date,
  CASE WHEN register_name = 'Risks_Issues' THEN {_R[0]} END AS kind, CASE WHEN register_name = 'Actions' THEN coalesce(nullif({_fold("severity")}, ''), 'medium') END AS priority, CASE WHEN register_name = 'Open_Questions' THEN blocking END AS blocking,
  CASE WHEN register_name = 'Sources' THEN 'source-intelligence' END AS source_type, CASE WHEN register_name = 'Sources' THEN CAST(source_id AS VARCHAR) END AS external_path, {_UNREAD} AS unrecognised
FROM (SELECT * REPLACE (coalesce(status, 'open') AS status) FROM v_kinds) WHERE {_TABLE} IS NOT NULL""")
def project_tables(spark, sf):
    """Operational rows: each register's own table (seven) with its defaults, and the wording that no mapping recognised."""
    s = with_kind_text(spark, sf).withColumn("status", F.coalesce("status", F.lit("open")))
    name = F.create_map(*[F.lit(x) for kv in TABLES.items() for x in kv])[F.col("register_name")]
    register = F.col("register_name")
    d, m, k = mapped("status", DECISION, "awaiting-user"), mapped("status", MILESTONE, "not-started"), mapped("kind_text", RISK, "risk")
    own = register != "Sources"
    status = F.when(register == "Decisions", d[0]).when(register == "Milestones", m[0]).when(own, F.col("status"))
    due = F.when(register == "Milestones", F.coalesce("due_date", F.lit("9999-12-31").cast("date"))).when(own, F.col("due_date"))
    unread = F.when((register == "Decisions") & ~d[1] | (register == "Milestones") & ~m[1], F.col("status")).when((register == "Risks_Issues") & ~k[1], F.concat(F.lit("type "), "kind_text"))
    priority = folded("severity")
    return s.where(register.isin(list(TABLES))).select(
        name.alias("table_name"), "project_id", F.col("external_id").alias("id"), "title", status.alias("status"), F.when(own, F.coalesce("owner", F.lit("Unassigned"))).alias("owner"), due.alias("due_date"),
        F.when(register == "Risks_Issues", k[0]).alias("kind"), F.when(register == "Actions", F.when(priority != "", priority).otherwise("medium")).alias("priority"), F.when(register == "Open_Questions", F.col("blocking")).alias("blocking"),
        F.when(~own, "source-intelligence").alias("source_type"), F.when(~own, F.col("source_id").cast("string")).alias("external_path"), unread.alias("unrecognised"),
    )


@query(f"""SELECT external_id, by_band OR unread AS needs, CASE WHEN by_band OR unread THEN concat_ws('. ', CASE WHEN by_band THEN band || ' band; explainable score ' || score || '; ' || CASE WHEN ownership = 'unowned' THEN 'no owner recorded' ELSE 'owned by the implementation consultant' END END,
CASE WHEN unread THEN 'status wording "' || status || '" was not recognised and has not been classified' END) || '.' END AS reason
FROM (SELECT *, band IN ('Now', 'Soon') AND ownership <> 'customer' AS by_band, register_name = 'Decisions' AND NOT {_D[1]} AS unread FROM v_scored WHERE status IS NOT NULL)""")
def attention_flags(spark, sf):
    s = scored(spark, sf).where("status IS NOT NULL")
    s = s.withColumn("by_band", F.col("band").isin("Now", "Soon") & (F.col("ownership") != "customer")).withColumn("unread", (F.col("register_name") == "Decisions") & ~mapped("status", DECISION, "")[1])
    first = F.when(F.col("by_band"), F.concat("band", F.lit(" band; explainable score "), F.col("score").cast("string"), F.lit("; "), F.when(F.col("ownership") == "unowned", "no owner recorded").otherwise("owned by the implementation consultant")))
    second = F.when(F.col("unread"), F.concat(F.lit('status wording "'), "status", F.lit('" was not recognised and has not been classified')))
    needs = F.col("by_band") | F.col("unread")
    return s.select("external_id", needs.alias("needs"), F.when(needs, F.concat(F.concat_ws(". ", first, second), F.lit("."))).alias("reason"))


@query(f"SELECT external_id, project_id, {_TABLE} AS was_table, CASE WHEN external_id % 17 = 0 THEN 'gone' ELSE 'moved' END AS cause FROM v_rows WHERE {_TABLE} IS NOT NULL AND (external_id % 17 = 0 OR external_id % 19 = 0)")
def retired_rows(spark, sf):
    """Rows projected by an earlier snapshot that are no longer current, or now belong to another table."""
    r = views.rows(spark, sf)
    name = F.create_map(*[F.lit(x) for kv in TABLES.items() for x in kv])[F.col("register_name")]
    ledger = r.select("external_id", "project_id", name.alias("was_table")).where("was_table IS NOT NULL")
    now = r.where("external_id % 17 <> 0").select("external_id", F.when(F.col("external_id") % 19 == 0, F.lit("archive")).otherwise(name).alias("table_name"))
    gone = ledger.join(now, "external_id", "left_anti").withColumn("cause", F.lit("gone"))
    moved = ledger.join(now, "external_id").where("table_name IS NULL OR was_table <> table_name").select("external_id", "project_id", "was_table", F.lit("moved").alias("cause"))
    return gone.unionByName(moved)


@query("SELECT external_id, CASE WHEN m.id IS NULL THEN NULL ELSE r.external_id + 5 END AS milestone_id, m.id IS NULL AS repaired FROM v_rows r LEFT JOIN (SELECT external_id AS id FROM v_rows WHERE register_name = 'Milestones') m ON r.external_id + 5 = m.id WHERE register_name = 'Actions'")
def dangling_refs(spark, sf):
    r = views.rows(spark, sf)
    m = r.where("register_name = 'Milestones'").select(F.col("external_id").alias("milestone_id"))
    a = r.where("register_name = 'Actions'").select("external_id", (F.col("external_id") + 5).alias("wanted"))
    return a.join(m, F.col("wanted") == F.col("milestone_id"), "left").select("external_id", "milestone_id", F.col("milestone_id").isNull().alias("repaired"))


@query("SELECT project_id, n_changesets + n_events AS revision, n_changesets, n_events FROM (SELECT project_id, count(DISTINCT changeset_id) AS n_changesets FROM v_rows JOIN v_ops ON external_id = target_id WHERE op_status = 'accepted' GROUP BY project_id) JOIN (SELECT project_id, count(e.row_id) AS n_events FROM v_rows LEFT JOIN v_events e ON external_id = e.row_id GROUP BY project_id) USING (project_id)")
def revisions(spark, sf):
    r = views.rows(spark, sf).select("project_id", "external_id")
    applied = r.join(ops(spark, sf).where("op_status = 'accepted'"), F.col("external_id") == F.col("target_id")).groupBy("project_id").agg(F.count_distinct("changeset_id").alias("n_changesets"))
    human = r.join(views.events(spark, sf), F.col("external_id") == F.col("row_id"), "left").groupBy("project_id").agg(F.count("row_id").alias("n_events"))
    return applied.join(human, "project_id").select("project_id", (F.col("n_changesets") + F.col("n_events")).alias("revision"), "n_changesets", "n_events")


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN p_brand END AS option_brand, CASE p_size % 3 WHEN 1 THEN p_type END AS impact_type, CASE p_size % 3 WHEN 2 THEN CAST(p_retailprice AS VARCHAR) END AS cost_text, ['Decisions','Risks_Issues','Config_Changes'][p_size % 3 + 1] AS register_name FROM part")
def typed_details(spark, sf):
    """Each register's own typed columns, selected from the raw map of the row."""
    p = views.read(spark, sf, "part")
    raw = p.select(F.col("p_partkey").alias("id"), views.pick(["Decisions", "Risks_Issues", "Config_Changes"], F.col("p_size") % 3).alias("register_name"), F.create_map(F.lit("Brand"), "p_brand", F.lit("impact-type"), "p_type", F.lit("COST"), F.col("p_retailprice").cast("string")).alias("raw"))
    keyed = raw.withColumn("raw", F.transform_keys("raw", lambda k, v: F.regexp_replace(F.lower(k), "[^a-z0-9]+", "_")))
    of = lambda register, key: F.when(F.col("register_name") == register, F.col("raw")[key])
    return keyed.select("id", of("Decisions", "brand").alias("option_brand"), of("Risks_Issues", "impact_type").alias("impact_type"), of("Config_Changes", "cost").alias("cost_text"), "register_name")


def advance(snapshots: sinks.Snapshots, events: DataFrame) -> int:
    """Commit the replay of a log of human events as the next version: only events past the mark of the current one are
    replayed, and merged with what it holds. The mark is the log's own number, so an event that was late in its time counts."""
    now = snapshots.manifest()
    mark = now["marks"].get("event_seq")
    new = events if mark is None else events.where(F.col("event_seq") > mark)
    last = new.agg(F.max("event_seq")).first()[0]
    if last is None:
        return now["version"]
    state = scoring.replay(new)
    if mark is not None:
        state = scoring.merge_replays(state, snapshots.read("replay"))
    return snapshots.commit({"replay": state}, {"event_seq": last}, base=now)


@query("SELECT row_id, status, owner, due_date, resolution, has_status, has_owner, has_due, has_resolution, n_events FROM v_replayed")
def snapshot_state(spark, sf):
    """The register's state from a snapshot of the log's first half and the events after it: what a replay of the log gives."""
    e = views.events(spark, sf)
    half = e.agg(F.floor(F.avg("event_seq"))).first()[0]
    snapshots = sinks.Snapshots(spark, f"{shared_dir(spark)}/register-{uuid.uuid4().hex}")
    advance(snapshots, e.where(F.col("event_seq") <= F.lit(half)))
    advance(snapshots, e)
    return asserted(snapshots.read("replay"))


@query("""SELECT 'rows' AS table_name, project_id, count(*) AS n_rows FROM v_rows GROUP BY ALL UNION ALL SELECT 'state', project_id, count(*) FROM v_state GROUP BY ALL
UNION ALL SELECT 'scores', project_id, count(*) FROM v_scored GROUP BY ALL UNION ALL SELECT 'ops', r.project_id, count(*) FROM v_ops o LEFT JOIN v_rows r ON r.external_id = o.target_id GROUP BY ALL
UNION ALL SELECT 'report', project_id, count(DISTINCT band) FROM v_scored GROUP BY ALL""")
def snapshot_tables(spark, sf):
    """Rows, state, scores, operations and a report of bands, committed as one version and read back from it."""
    r, s = views.rows(spark, sf), materialize(scored(spark, sf), "scored")
    operations = ops(spark, sf).join(r.select(F.col("external_id").alias("target_id"), "project_id"), "target_id", "left")
    tables = {"rows": r, "state": current(spark, sf), "scores": s.select("external_id", "project_id", "score", "band"), "ops": operations, "report": s.groupBy("project_id", "band").agg(F.count("*").alias("n"), F.sum("score").alias("score"))}
    snapshots = sinks.Snapshots(spark, f"{shared_dir(spark)}/register-{uuid.uuid4().hex}")
    version = snapshots.commit(tables)
    counts = [snapshots.read(name, version).groupBy("project_id").agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "project_id", "n_rows") for name in tables]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT project_id, count(*) AS n_rows, sum(score) AS score, count(DISTINCT external_id) AS n_ids FROM v_scored GROUP BY project_id")
def snapshot_scores(spark, sf):
    """Scored rows written as a snapshot partitioned by project, and what a reader of it finds."""
    rows = scored(spark, sf).select("external_id", "project_id", "status", "owner", "due_date", "score", "band")
    snapshots = sinks.Snapshots(spark, f"{shared_dir(spark)}/register-{uuid.uuid4().hex}")
    snapshots.commit({"scores": rows})
    back = snapshots.read("scores")
    return back.groupBy("project_id").agg(F.count("*").alias("n_rows"), F.sum("score").alias("score"), F.count_distinct("external_id").alias("n_ids"))
