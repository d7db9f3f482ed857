"""Registry, runs and job tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from regista.functions import texts as T
from regista.plans import views
from regista.plans.registry import query
from regista.plans.text import q
from regista.plans.views import VIEW_SQL

VIEW_SQL["v_versions"] = "SELECT p_partkey AS revision_id, p_brand AS skill, (p_size % 4) || '.' || (p_partkey % 12) || '.' || (p_size % 15) AS version, p_type AS kind, p_retailprice AS price FROM part"


def versions(spark, sf):
    p = views.read(spark, sf, "part")
    v = F.concat_ws(".", (F.col("p_size") % 4).cast("string"), (F.col("p_partkey") % 12).cast("string"), (F.col("p_size") % 15).cast("string"))
    return p.select(F.col("p_partkey").alias("revision_id"), F.col("p_brand").alias("skill"), v.alias("version"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("price"))


def numeric(version):
    """A dotted version as an array of numbers, which orders as versions do."""
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int"))


_NUMERIC = "list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER))"


@query(f"SELECT skill, arg_max(version, ({_NUMERIC}, revision_id)) AS latest, count(*) AS n_versions, count_if(NOT up) AS n_not_increasing FROM (SELECT *, coalesce({_NUMERIC} > lag({_NUMERIC}) OVER (PARTITION BY skill ORDER BY revision_id), true) AS up FROM v_versions) GROUP BY skill")
def latest_version(spark, sf):
    v = versions(spark, sf).withColumn("n", numeric("version"))
    up = F.coalesce(F.col("n") > F.lag("n").over(Window.partitionBy("skill").orderBy("revision_id")), F.lit(True))
    return v.withColumn("up", up).groupBy("skill").agg(F.max_by("version", F.struct("n", "revision_id")).alias("latest"), F.count("*").alias("n_versions"), F.count_if(~F.col("up")).alias("n_not_increasing"))


@query("SELECT skill, kind, revision_id, layer FROM (SELECT *, row_number() OVER (PARTITION BY skill, kind ORDER BY layer DESC, revision_id) AS r FROM (SELECT *, revision_id % 3 AS layer FROM v_versions)) WHERE r = 1")
def registry_overlay(spark, sf):
    """Of the same key the entry of the highest layer stands."""
    v = versions(spark, sf).withColumn("layer", F.col("revision_id") % 3)
    return v.groupBy("skill", "kind").agg(F.min_by(F.struct("revision_id", "layer"), F.struct(-F.col("layer"), "revision_id")).alias("r")).select("skill", "kind", "r.revision_id", "r.layer")


@query("SELECT revision_id, CASE WHEN revision_id % 7 = 0 THEN 'new' WHEN revision_id % 11 = 0 THEN 'rewritten-in-place' WHEN revision_id % 13 = 0 THEN 'gone' ELSE 'unchanged' END AS change FROM v_versions")
def registry_diff(spark, sf):
    """What a directory holds against what is registered."""
    v = versions(spark, sf)
    h = F.sha2(F.concat_ws("|", "skill", "version", "kind"), 256)
    old = v.where("revision_id % 7 <> 0").select("revision_id", h.alias("old"))
    new = v.where("revision_id % 13 <> 0 OR revision_id % 7 = 0 OR revision_id % 11 = 0").select("revision_id", F.when((F.col("revision_id") % 11 == 0) & (F.col("revision_id") % 7 != 0), F.sha2(h, 256)).otherwise(h).alias("new"))
    j = old.join(new, "revision_id", "full")
    return j.select("revision_id", F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "rewritten-in-place").otherwise("unchanged").alias("change"))


@query("SELECT n_nationkey AS project_id, s.skill, coalesce(p.revision_id, s.active) AS revision_id, p.revision_id IS NOT NULL AS pinned FROM nation CROSS JOIN (SELECT skill, max(revision_id) AS active FROM v_versions GROUP BY skill) s LEFT JOIN (SELECT revision_id % 25 AS project_id, skill, min(revision_id) AS revision_id FROM v_versions WHERE revision_id % 9 = 0 GROUP BY ALL) p ON p.project_id = n_nationkey AND p.skill = s.skill")
def revision_in_force(spark, sf):
    """A project's pin, else the active revision. Projects are the 25 nations, so the cross is of a fixed size."""
    v = versions(spark, sf)
    active = v.groupBy("skill").agg(F.max("revision_id").alias("active"))
    pins = v.where("revision_id % 9 = 0").groupBy((F.col("revision_id") % 25).cast("int").alias("project_id"), "skill").agg(F.min("revision_id").alias("pin"))
    every = active.withColumn("project_id", F.explode(F.sequence(F.lit(0), F.lit(24))))
    return every.join(pins, ["project_id", "skill"], "left").select("project_id", "skill", F.coalesce("pin", "active").alias("revision_id"), F.col("pin").isNotNull().alias("pinned"))


@query("SELECT user_id, last_step, n_active, n_illegal FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_step, count_if(event_type = 'signup') AS n_active, count_if(event_type = 'purchase' AND NOT seen) AS n_illegal FROM (SELECT *, coalesce(bool_or(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM events) GROUP BY user_id)")
def lifecycle_rules(spark, sf):
    """A fold of the audit log: the last step, activations, and rollbacks to what was never active."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = views.read(spark, sf, "events").withColumn("seen", F.coalesce(F.bool_or(F.col("event_type") == "signup").over(before), F.lit(False)))
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_step"), F.count_if(F.col("event_type") == "signup").alias("n_active"), F.count_if((F.col("event_type") == "purchase") & ~F.col("seen")).alias("n_illegal"))


@query("SELECT user_id, count(*) AS uses, max(ts) AS last_used, count_if(kind = 'run') AS n_runs FROM (SELECT user_id, ts, 'run' AS kind FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT user_id, ts, 'benchmark' FROM events WHERE event_type = 'purchase') GROUP BY user_id")
def revision_usage(spark, sf):
    e = views.read(spark, sf, "events")
    both = e.where("event_type IN ('click', 'view')").select("user_id", "ts", F.lit("run").alias("kind")).unionByName(e.where("event_type = 'purchase'").select("user_id", "ts", F.lit("benchmark").alias("kind")))
    return both.groupBy("user_id").agg(F.count("*").alias("uses"), F.max("ts").alias("last_used"), F.count_if(F.col("kind") == "run").alias("n_runs"))


@query("SELECT v.revision_id, v.skill, v.version, coalesce(u.uses, 0) AS uses, round(u.latest_score, 4) AS latest_score FROM v_versions v LEFT JOIN (SELECT l_partkey, count(*) AS uses, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS latest_score FROM lineitem GROUP BY l_partkey) u ON u.l_partkey = v.revision_id")
def catalogue(spark, sf):
    u = views.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("revision_id")).agg(F.count("*").alias("uses"), F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("s"))
    return versions(spark, sf).join(u, "revision_id", "left").select("revision_id", "skill", "version", F.coalesce("uses", F.lit(0)).alias("uses"), F.round("s", 4).alias("latest_score"))


@query("SELECT event_id, ts, event_type FROM events WHERE event_type IN ('signup', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_trail(spark, sf):
    e = views.read(spark, sf, "events").where("event_type IN ('signup', 'purchase')")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts", "event_type")


@query("SELECT l.l_orderkey, l.l_linenumber, coalesce(CASE WHEN l.l_linenumber > 2 THEN l.l_suppkey END, f.l_suppkey) AS run_id FROM lineitem l LEFT JOIN (SELECT l_partkey, arg_min(l_suppkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_suppkey FROM lineitem WHERE l_linenumber > 2 GROUP BY l_partkey) f ON f.l_partkey = l.l_partkey")
def provenance_backfill(spark, sf):
    """A missing run becomes the earliest one of the same source (here part)."""
    li = views.read(spark, sf, "lineitem")
    first = li.where("l_linenumber > 2").groupBy("l_partkey").agg(F.min_by("l_suppkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("first"))
    return li.join(first, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce(F.when(F.col("l_linenumber") > 2, F.col("l_suppkey")), F.col("first")).alias("run_id"))


@query("SELECT event_id, CASE WHEN event_id % 4 >= 3 THEN 'quarantine' ELSE 'requeue' END AS action, CASE WHEN event_id % 3 = 0 THEN 'lease expired' ELSE 'quiet' END AS why FROM events WHERE event_type = 'view' AND ((event_id % 3 = 0 AND ts + INTERVAL 10 MINUTE < TIMESTAMP '2024-01-20') OR (event_id % 3 <> 0 AND ts <= TIMESTAMP '2024-01-20' - INTERVAL 10 MINUTE))")
def stalled_jobs(spark, sf):
    return stalled(views.read(spark, sf, "events"))


def stalled(events: DataFrame) -> DataFrame:
    """Jobs in flight whose lease ran out, or without a lease and quiet for ten minutes; by attempts requeued or set aside."""
    leased = F.col("event_id") % 3 == 0
    ts = F.col("ts").cast("timestamp_ntz")
    at = F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    late = F.when(leased, ts + F.expr("INTERVAL 10 MINUTES") < at).otherwise(ts <= at - F.expr("INTERVAL 10 MINUTES"))
    e = events.where("event_type = 'view'").where(late)
    return e.select("event_id", F.when(F.col("event_id") % 4 >= 3, "quarantine").otherwise("requeue").alias("action"), F.when(leased, "lease expired").otherwise("quiet").alias("why"))


#: What an operator does about each kind of failure; "budget" is told by a run's tokens, not by its text.
RECOVERY = {
    "cli-missing": "install the provider's program on the path, then retry",
    "cli-too-old": "upgrade the provider's program, then retry; the same version fails again",
    "model-unsupported": "configure a model that the provider offers, then retry",
    "auth": "sign in to the provider, then retry",
    "transient": "retry when the provider can be reached",
    "budget": "raise the budget or cut the source into smaller windows, then retry",
    "unknown": "read the recorded error, then retry",
}
#: Tokens (here a customer's number modulo 1,000) beyond which a run is over its budget.
BUDGET = 950
_RECOVERY = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in RECOVERY.items()) + " END"


@query(
    f"SELECT kind, count(*) AS n_notes, kind IN ('transient', 'unknown') AS retryable, {_RECOVERY} AS recovery FROM (SELECT CASE WHEN source_id % 1000 > {BUDGET} THEN 'budget' "
    + " ".join(f"WHEN regexp_matches(lower(text), {q(p)}) THEN '{k}'" for k, p in T.FAILURES) + " ELSE 'unknown' END AS kind FROM v_notes) GROUP BY kind"
)
def failure_kinds(spark, sf):
    """Failed runs by kind, whether a retry may help as things are, and what to do."""
    kind = F.when(F.col("source_id") % 1000 > BUDGET, "budget").otherwise(T.failure_kind("text"))
    recovery = F.create_map(*[F.lit(x) for kv in RECOVERY.items() for x in kv])
    n = views.notes(spark, sf).groupBy(kind.alias("kind")).agg(F.count("*").alias("n_notes"))
    return n.select("kind", "n_notes", F.col("kind").isin("transient", "unknown").alias("retryable"), recovery[F.col("kind")].alias("recovery"))


@query("SELECT user_id, event_type, count(*) AS n_runs, CAST(sum(CAST(value * 100 AS DECIMAL(18, 0))) AS BIGINT) AS tokens, CASE WHEN grouping(user_id) = 1 AND grouping(event_type) = 1 THEN 'all' WHEN grouping(event_type) = 1 THEN 'source' WHEN grouping(user_id) = 1 THEN 'model' ELSE 'cell' END AS level FROM events GROUP BY CUBE (user_id, event_type)")
def run_costs(spark, sf):
    c = views.read(spark, sf, "events").cube("user_id", "event_type").agg(F.count("*").alias("n_runs"), F.sum(F.expr("CAST(value * 100 AS DECIMAL(18, 0))")).cast("long").alias("tokens"), F.grouping("user_id").alias("gu"), F.grouping("event_type").alias("ge"))
    level = F.when((F.col("gu") == 1) & (F.col("ge") == 1), "all").when(F.col("ge") == 1, "source").when(F.col("gu") == 1, "model").otherwise("cell")
    return c.select("user_id", "event_type", "n_runs", "tokens", level.alias("level"))


@query("SELECT user_id, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, event_id)) AS last_usage, arg_max(event_id, (ts, event_id)) AS last_message, count(*) AS n_lines FROM events GROUP BY user_id")
def run_usage(spark, sf):
    """Last message and last usage of a run from its event lines."""
    e = views.read(spark, sf, "events").withColumn("u", F.from_json("props", "k long")["k"])
    last = e.groupBy("user_id").agg(F.max_by(F.struct("u", "event_id"), F.struct("ts", "event_id")).alias("r"), F.count("*").alias("n_lines"))
    return last.select("user_id", F.col("r.u").alias("last_usage"), F.col("r.event_id").alias("last_message"), "n_lines")
