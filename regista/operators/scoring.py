"""Replay of events to current state, importance scores and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the current scoring version.
WEIGHTS = {
    "register": {"Decisions": 90, "Risks_Issues": 80, "Actions": 70, "Open_Questions": 60, "Config_Changes": 40, "Milestones": 40, "Uncertainty": 30, "Entities": 10, "Sources": 0},
    "severity": {"critical": 40, "high": 25, "medium": 10, "low": 0},
    "likelihood": {"almost-certain": 15, "likely": 10, "possible": 5, "unlikely": 0},
    "urgency": {"overdue": 50, "three": 30, "seven": 15, "fourteen": 5},
    "ownership": {"consultant": 20, "customer": 10},
    "flags": {"blocking": 35, "latest": 25, "supersession": 40, "conflict": 45, "uncertainty": 15, "staleness": 10, "closure": -200},
    "stale_days": 21,
    "bands": {"now": 120, "soon": 80, "watch": 40},
}
CLOSED = ["resolved", "closed", "complete", "completed", "superseded", "rejected", "ratified", "agreed", "agreed in principle", "accepted"]
UNOWNED = ["", "-", "--", "n/a", "na", "none", "nobody", "no owner", "not assigned", "not yet assigned", "not stated", "tbc", "tbd", "unassigned", "unowned", "unknown"]
VERBS = {"complete": "completed", "close": "resolved", "resolve": "resolved", "ratify": "ratified", "reject": "rejected", "park": "parked", "reopen": "open"}


def folded(c: str | Column) -> Column:
    """Lower case, white space collapsed; null as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " ")))


def weight(of: Column, table: dict[str, int]) -> Column:
    """A weight by label, 0 for others."""
    out = F.lit(0)
    for label, value in table.items():
        out = F.when(of == label, value).otherwise(out)
    return out


def is_unowned(owner: str | Column) -> Column:
    return F.regexp_replace(folded(owner), "[.!]+$", "").isin(UNOWNED)


def ownership(owner: str | Column) -> Column:
    """unowned, consultant or customer."""
    name = folded(owner)
    return F.when(is_unowned(owner), "unowned").when((name == "consultant") | name.contains("implementation consultant"), "consultant").otherwise("customer")


def is_closed(status: str | Column) -> Column:
    return folded(status).isin(CLOSED)


def last_by(value: Column, when: Column, *order: str) -> Column:
    """Latest value in event order among rows where ``when``, with its place in that order; a struct, so that a null value
    differs from no event."""
    return F.max_by(F.when(when, F.struct(value.alias("v"), *order)), F.when(when, F.struct(*order)))


def replay(events: DataFrame) -> DataFrame:
    """Per row the last asserted status, owner, due_date and resolution (structs), and the last event: in one aggregation.
    Within an event the verb overrides the field."""
    by_verb = F.lit(None).cast("string")
    for verb, status in VERBS.items():
        by_verb = F.when(F.col("verb") == verb, status).otherwise(by_verb)
    order = ("occurred_at", "event_seq")
    status = F.coalesce(by_verb, F.col("new_value"))
    owner = F.when(~is_unowned("new_value"), F.col("new_value"))
    return events.groupBy("row_id").agg(
        last_by(status, by_verb.isNotNull() | (F.col("field") == "status"), *order).alias("status"),
        last_by(owner, F.col("field") == "owner", *order).alias("owner"),
        last_by(F.col("new_value"), F.col("field") == "due_date", *order).alias("due_date"),
        last_by(F.col("new_value"), F.col("field") == "resolution", *order).alias("resolution"),
        F.max("occurred_at").alias("last_event_at"), F.count("*").alias("n_events"),
    )


def merge_replays(batch: DataFrame, state: DataFrame) -> DataFrame:
    """The replay of all events from those of two parts of them: per field the later assertion counts."""
    fields = ("status", "owner", "due_date", "resolution")
    later = [F.max_by(f, F.struct(F.col(f)["occurred_at"], F.col(f)["event_seq"])).alias(f) for f in fields]
    return batch.unionByName(state).groupBy("row_id").agg(*later, F.max("last_event_at").alias("last_event_at"), F.sum("n_events").alias("n_events"))


def score(rows: DataFrame, as_of: Column, weights: dict = WEIGHTS) -> DataFrame:
    """``rows`` with due_days, closed, severity_label, score and band. Needs register_name, severity, likelihood, blocking,
    due_date, owner, status, created_on, n_events and the flags latest, superseding, conflict, uncertain."""
    w, flags, bands = weights, weights["flags"], weights["bands"]
    due = F.datediff("due_date", as_of)
    closed = is_closed("status")
    severity = folded("severity")
    own = ownership("owner")
    stale = ~closed & (F.coalesce("n_events", F.lit(0)) == 0) & (F.datediff(as_of, "created_on") > w["stale_days"])
    u = w["urgency"]
    urgency = F.when(due < 0, u["overdue"]).when(due <= 3, u["three"]).when(due <= 7, u["seven"]).when(due <= 14, u["fourteen"]).otherwise(0)
    flag = lambda c, name: F.when(F.coalesce(c, F.lit(False)), flags[name]).otherwise(0)
    total = (
        weight(F.col("register_name"), w["register"]) + weight(severity, w["severity"]) + weight(F.regexp_replace(folded("likelihood"), " ", "-"), w["likelihood"])
        + flag(F.col("blocking"), "blocking") + urgency + F.when(own == "unowned", 0).when(own == "consultant", w["ownership"]["consultant"]).otherwise(w["ownership"]["customer"])
        + flag(F.col("latest"), "latest") + flag(F.col("superseding"), "supersession") + flag(F.col("conflict"), "conflict") + flag(F.col("uncertain"), "uncertainty")
        + flag(stale, "staleness") + flag(closed, "closure")
    )
    out = rows.withColumns({"due_days": due, "closed": closed, "severity_label": severity, "ownership": own, "stale": stale}).withColumn("score", total.cast("int"))
    band = (
        F.when(F.col("closed"), "Reference").when(F.coalesce(F.col("blocking") | F.col("conflict") | (F.col("due_days") < 0), F.lit(False)) | F.coalesce(F.col("blocking"), F.lit(False)), "Now")
        .when((F.col("due_days") <= 7) | F.col("severity_label").isin("critical", "high"), "Soon")
        .when(F.col("score") >= bands["now"], "Now").when(F.col("score") >= bands["soon"], "Soon").when(F.col("score") >= bands["watch"], "Watch").otherwise("Reference")
    )
    return out.withColumn("band", band)


def faults(weights: dict) -> list[str]:
    """What makes a version of the weights invalid: parts that are missing or no numbers, bands out of order."""
    found = [f"{part} missing" for part in ("register", "severity", "likelihood", "flags", "urgency", "ownership", "bands", "stale_days") if part not in weights]
    for part, value in weights.items():
        numbers = value.values() if isinstance(value, dict) else [value]
        if any(isinstance(n, bool) or not isinstance(n, (int, float)) for n in numbers):
            found.append(f"{part} not numeric")
    bands = weights.get("bands", {})
    if not found and not bands.get("now", 0) > bands.get("soon", 0) > bands.get("watch", 0):
        found.append("bands out of order")
    return found


def active(versions: list[tuple[str, bool, dict]]) -> tuple[str, dict]:
    """The one active valid version of (name, active, weights); anything else is an error."""
    chosen = [(name, weights) for name, on, weights in versions if on]
    if len(chosen) != 1:
        raise ValueError(f"exactly one version of the weights must be active, not {len(chosen)}")
    if found := faults(chosen[0][1]):
        raise ValueError(f"the active version is invalid: {', '.join(found)}")
    return chosen[0]
