"""Nested JSON imports: portfolio documents and register packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regista.plans.store import materialize

ENTITIES = ("actions", "risksIssues", "decisions", "openQuestions", "milestones", "workPackages", "activity", "aiWork")
_RECORD = "array<struct<id:string,title:string,status:string,owner:string,updatedAt:string,dueDate:string,severity:string,priority:string>>"
_PORTFOLIO = "schemaVersion int, dataClassification string, asOf string, projects array<struct<id:string,name:string,code:string,owner:string," + ",".join(f"{e}:{_RECORD}" for e in ENTITIES) + ">>"

# Names under which a packet's rows give their id.
ID_NAMES = "id external_id externalid ref reference item_id row_id register_id decision_id action_id risk_id question_id milestone_id".split()


def portfolio(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One table per entity of portfolio documents in files, each row with its project."""
    return entities(spark.read.schema(_PORTFOLIO).option("multiLine", "true").json(path))


def portfolio_text(documents: DataFrame, text: str = "text") -> dict[str, DataFrame]:
    """The same of documents held as JSON text in a column."""
    return entities(documents.select(F.from_json(text, _PORTFOLIO).alias("d")).select("d.*"))


def portfolio_records(documents: DataFrame, text: str = "text") -> DataFrame:
    """(entity, project_id, id, title, status, due_on) of every record of such documents, the projects among them: one pass
    over the texts, however many entities there are."""
    shape = "array<struct<entity:string,id:string,title:string,status:string,due_on:string>>"
    p = documents.select(F.from_json(text, _PORTFOLIO).alias("d")).select(F.inline("d.projects"))
    none = F.lit(None).cast("string")
    own = F.array(F.struct(F.lit("projects"), "id", "name", none, none)).cast(shape)
    record = lambda e: lambda r: F.struct(F.lit(e), r["id"], r["title"], r["status"], r["dueDate"])
    held = [F.coalesce(F.transform(e, record(e)).cast(shape), F.array().cast(shape)) for e in ENTITIES]
    return p.select(F.col("id").alias("project_id"), F.inline(F.concat(own, *held))).select("entity", "project_id", "id", "title", "status", "due_on")


def entities(documents: DataFrame) -> dict[str, DataFrame]:
    projects = documents.select(F.inline("projects"))
    tables = {"projects": projects.select("id", "name", "code", "owner")}
    for e in ENTITIES:
        tables[e] = projects.select(F.col("id").alias("project_id"), F.inline(e))
    return tables


def import_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, table in tables.items():
        n = table.agg(F.lit(name).alias("entity"), F.count("*").alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out


def screened(documents: DataFrame) -> DataFrame:
    """``documents`` (packet, code, text) with ``refused``: why a packet is not read at all. The first packet (by name) of a
    content counts, a later one changes nothing; a packet that names another project's code is rejected."""
    d = documents.withColumn("hash", F.sha2("text", 256))
    first = d.groupBy("code", "hash").agg(F.min("packet").alias("first"))
    j = d.join(first, ["code", "hash"], "left")
    named = F.get_json_object("text", "$.project_code")
    return j.withColumn("refused", F.when(F.col("packet") != F.col("first"), "same content").when(named.isNotNull() & (named != F.col("code")), "code mismatch")).drop("first", "hash")


def packets(documents: DataFrame, registers: list[str]) -> DataFrame:
    """(packet, register_name, external_id, row, reason): rows of register packets given as JSON text. Registers may be arrays
    or objects that hold rows; unknown ones are skipped; a missing or repeated id rejects a row."""
    rows = "array<map<string,string>>"
    shape = F.from_json("text", "map<string,string>")
    named = documents.select("packet", F.explode(shape).alias("register_name", "body")).where(F.col("register_name").isin(registers))
    listed = F.coalesce(F.from_json("body", rows), F.from_json(F.get_json_object("body", "$.rows"), rows))
    each = named.select("packet", "register_name", F.explode(listed).alias("row"))
    keyed = each.withColumn("row", F.transform_keys("row", lambda k, v: F.regexp_replace(F.lower(k), "[^a-z0-9]+", "_")))
    ident = F.coalesce(*[F.when(F.trim(F.col("row")[n]) != "", F.trim(F.col("row")[n])) for n in ID_NAMES])
    keyed = keyed.withColumn("external_id", ident)
    repeated = keyed.groupBy(F.col("packet").alias("p"), F.col("register_name").alias("r"), F.col("external_id").alias("e")).agg(F.count("*").alias("n"))
    j = keyed.join(repeated, F.col("packet").eqNullSafe(F.col("p")) & F.col("register_name").eqNullSafe(F.col("r")) & F.col("external_id").eqNullSafe(F.col("e")))
    reason = F.when(F.col("external_id").isNull(), "missing id").when(F.col("n") > 1, "repeated id")
    return j.select("packet", "register_name", "external_id", "row", reason.alias("reason"))


def imported(documents: DataFrame, registers: list[str]) -> DataFrame:
    """(packet, register_name, external_id, reason) of all packets: their rows, or one row that says why they are refused.
    The documents are stored first: texts made of gathered lists may come out in another order when they are made again, and
    then a packet would not be found among the contents."""
    seen = screened(materialize(documents, "documents"))
    taken = packets(seen.where("refused IS NULL"), registers).select("packet", "register_name", "external_id", "reason")
    none = F.lit(None).cast("string")
    return taken.unionByName(seen.where("refused IS NOT NULL").select("packet", none.alias("register_name"), none.alias("external_id"), F.col("refused").alias("reason")))
