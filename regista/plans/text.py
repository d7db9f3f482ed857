"""Document normalisation: segments, windows, markers, dates, redaction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from regista.functions import texts as T
from regista.operators import token_spans
from regista.plans import views
from regista.plans.registry import query
from regista.plans.store import materialize
from regista.plans.views import VIEW_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(translate(coalesce({c}, ''), '‘’‚‛′“”„‟″‐‑‒–—―−', '''''''''''\"\"\"\"\"-------')), '\\s+', ' ', 'g'))"


def _clause(f: str, p: str) -> str:
    return f"coalesce(list_filter(regexp_split_to_array({f}, {q(T.CLAUSE_BOUNDARY)}), lambda c: regexp_matches(c, {q(p)}))[1], {f})"


def _commits(f: str, p: str) -> str:
    c = _clause(f, p)
    return f"(regexp_matches({c}, {q(T.FUTURE_MODAL)}) OR NOT (regexp_matches({c}, {q(T.PAST_TIME)}) OR regexp_matches({c}, {q(T.HYPOTHETICAL)})))"


_m = lambda p: f"regexp_matches(f, {q(p)})"
_MARKERS = [
    ("explicit-action", "high", T.EXPLICIT_ACTION, _m(T.EXPLICIT_ACTION)), ("explicit-register", "high", T.EXPLICIT_REGISTER, _m(T.EXPLICIT_REGISTER)),
    ("explicit-date", "high", T.DATE_PHRASE, f"{_m(T.DATE_PHRASE)} AND {_m(T.COMMITMENT_CUE)} AND {_commits('f', T.DATE_PHRASE)}"), ("scheduled-time", "high", T.SCHEDULED_TIME, f"{_m(T.SCHEDULED_TIME)} AND {_commits('f', T.SCHEDULED_TIME)}"),
    ("live-config-act", "high", T.LIVE_ACT, f"{_m(T.LIVE_ACT)} AND ({_m(T.CONFIG_OBJECT)} OR regexp_matches(regexp_extract(f, {q(T.LIVE_ACT)}), {q(T.SYSTEM_VERB)}))"), ("commitment-pattern", "medium", T.COMMITMENT, _m(T.COMMITMENT)),
    ("question-pattern", "medium", T.QUESTION, _m(T.QUESTION)), ("constraint-pattern", "medium", T.CONSTRAINT, _m(T.CONSTRAINT)), ("lexical", "low", T.LEXICAL, _m(T.LEXICAL)),
]
VIEW_SQL["v_folded"] = f"SELECT *, {fold_sql('text')} AS f FROM v_notes"
VIEW_SQL["v_markers"] = " UNION ALL ".join(f"SELECT note_id, source_id, '{n}' AS marker_type, '{c}' AS confidence, regexp_extract(f, {q(p)}) AS matched FROM v_folded WHERE {w}" for n, c, p, w in _MARKERS)


def marked(spark, sf):
    """Markers of the notes; a note is a segment, its seq its place in the source."""
    return views.notes(spark, sf).select("note_id", "source_id", F.inline(T.markers("text")))


@query("SELECT note_id, marker_type, confidence, matched FROM v_markers")
def marker_scan(spark, sf):
    return marked(spark, sf).drop("source_id")


@query(f"SELECT note_id, regexp_extract(f, {q(T.DATE_PHRASE)}) AS phrase, {_clause('f', T.DATE_PHRASE)} AS clause, {_commits('f', T.DATE_PHRASE)} AS committed FROM v_folded WHERE regexp_matches(f, {q(T.DATE_PHRASE)})")
def date_commitments(spark, sf):
    n = views.notes(spark, sf).withColumn("f", T.fold("text")).where(F.col("f").rlike(T.DATE_PHRASE))
    return n.select("note_id", F.regexp_extract("f", T.DATE_PHRASE, 0).alias("phrase"), T.first_clause(F.col("f"), T.DATE_PHRASE).alias("clause"), T.commits(F.col("f"), T.DATE_PHRASE).alias("committed"))


@query("SELECT source_id, count_if(confidence = 'high') AS high, count_if(confidence = 'medium') AS medium, count_if(confidence = 'low') AS low FROM v_markers GROUP BY source_id")
def marker_counts(spark, sf):
    return marked(spark, sf).groupBy("source_id").agg(*[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")])


@query("SELECT m.source_id, floor((s.seq - 1) / 4) AS window_seq, count(*) AS n_markers FROM v_markers m JOIN (SELECT note_id, row_number() OVER (PARTITION BY source_id ORDER BY note_id) AS seq FROM v_notes) s USING (note_id) WHERE confidence <> 'low' GROUP BY ALL")
def window_markers(spark, sf):
    """High and medium markers in each window of four notes."""
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("note_id"))
    n = views.notes(spark, sf).withColumn("seq", place).select("source_id", F.floor((F.col("seq") - 1) / 4).cast("double").alias("window_seq"), F.inline(T.markers("text")))
    return n.where("confidence <> 'low'").groupBy("source_id", "window_seq").agg(F.count("*").alias("n_markers"))


@query("""SELECT source_id, seq, last_value(name IGNORE NULLS) OVER (PARTITION BY source_id, span ORDER BY seq) AS speaker, name IS NULL AS carried FROM (
SELECT *, sum(CASE WHEN name IS NOT NULL OR closes THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY seq) AS span FROM (
SELECT source_id, seq, CASE WHEN seq % 3 = 1 THEN speaker END AS name, coalesce(lag(seq % 5 = 0) OVER (PARTITION BY source_id ORDER BY seq), false) AND seq % 3 <> 1 AS closes FROM v_segments))""")
def speaker_fill(spark, sf):
    """An untagged cue keeps the speaker of the span before it, until the span closes (every fifth cue closes one here)."""
    in_order = Window.partitionBy("source_id").orderBy("seq")
    s = views.segments(spark, sf).withColumn("name", F.when(F.col("seq") % 3 == 1, F.col("speaker")))
    s = s.withColumn("closes", F.coalesce(F.lag(F.col("seq") % 5 == 0).over(in_order), F.lit(False)) & F.col("name").isNull())
    s = s.withColumn("span", F.sum((F.col("name").isNotNull() | F.col("closes")).cast("int")).over(in_order))
    return s.select("source_id", "seq", F.last("name", ignorenulls=True).over(Window.partitionBy("source_id", "span").orderBy("seq")).alias("speaker"), F.col("name").isNull().alias("carried"))


@query("SELECT source_id, seq, CAST(start_ AS BIGINT) AS char_start, CAST(start_ + length(text) AS BIGINT) AS char_end FROM (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ FROM v_segments)")
def segment_offsets(spark, sf):
    before = Window.partitionBy("source_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    return views.segments(spark, sf).withColumn("char_start", start).select("source_id", "seq", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"))


@query("SELECT source_id, count(*) AS n_segments, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n_words, max(seq) AS last_seq, (SELECT string_agg(speaker, ',' ORDER BY first_seq) FROM (SELECT speaker, min(seq) AS first_seq FROM v_segments i WHERE i.source_id = o.source_id GROUP BY speaker)) AS participants FROM v_segments o GROUP BY source_id")
def doc_facts(spark, sf):
    """Segments, words, end, and distinct speakers in order of first appearance."""
    s = views.segments(spark, sf)
    by_speaker = s.groupBy("source_id", "speaker").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"), F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("w"), F.max("seq").alias("last"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "speaker"))), lambda x: x["speaker"]), ",")
    return by_speaker.groupBy("source_id").agg(F.sum("n").alias("n_segments"), F.sum("w").alias("n_words"), F.max("last").alias("last_seq"), names.alias("participants"))


@query(f"SELECT page_id, {'replace(' * 6}regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS raw FROM pages".replace("SELECT page_id, ", "SELECT page_id, trim(regexp_replace(").replace(" AS raw FROM", ", '[ \\t\\r\\n]+', ' ', 'g')) AS plain FROM"))
def strip_markup(spark, sf):
    return views.read(spark, sf, "pages").select("page_id", T.strip_markup("html").alias("plain"))


@query("""SELECT doc_id, CASE WHEN words = 0 THEN 0 ELSE CAST(ceil(round(greatest(chars / (4.0 - 1.4 * least(1.0, CAST(marks AS DOUBLE) / chars / 0.2)), words * 1.5 + marks * 0.75, CAST(chars AS DOUBLE) / 4), 9)) AS BIGINT) END AS n_tokens FROM (
SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, len(regexp_extract_all(text, '\\S+')) AS words, len(regexp_extract_all(text, '[^\\p{L}\\p{N}\\s]')) AS marks FROM documents WHERE text IS NOT NULL)""")
def token_estimate(spark, sf):
    return views.read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.token_estimate("text").alias("n_tokens"))


@query("SELECT note_id, lower(regexp_extract(text, '(?i)^(action|risk|issue|decision|question|milestone|work package|deliverable|change):\\s*(.+)$', 1)) AS tag, regexp_extract(text, '(?i)^(action|risk|issue|decision|question|milestone|work package|deliverable|change):\\s*(.+)$', 2) AS item FROM v_notes WHERE regexp_matches(text, '(?i)^(action|risk|issue|decision|question|milestone|work package|deliverable|change):\\s*(.+)$')")
def tagged_lines(spark, sf):
    tag = r"(?i)^(action|risk|issue|decision|question|milestone|work package|deliverable|change):\s*(.+)$"
    lines = views.notes(spark, sf).select("note_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(tag))
    return lines.select("note_id", F.lower(F.regexp_extract("line", tag, 1)).alias("tag"), F.regexp_extract("line", tag, 2).alias("item"))


_WEEK = "(monday|tuesday|wednesday|thursday|friday|saturday|sunday)"


@query("""SELECT note_id, CASE WHEN hard <> '' THEN try_cast(hard AS DATE) WHEN regexp_matches(text, '(?i)^(?:w/c|wc|week commencing)\\b') AND len(iso) > 0 THEN CAST(date_trunc('week', CAST(iso[1] AS DATE)) AS DATE) WHEN len(iso) = 1 THEN CAST(iso[1] AS DATE) WHEN len(iso) > 1 THEN CAST(iso[-1] AS DATE)
WHEN regexp_matches(low, '\\b(?:month end|end of (?:the )?month)\\b') THEN CAST(CASE dayofweek(last_day(event_date)) WHEN 0 THEN last_day(event_date) - 2 WHEN 6 THEN last_day(event_date) - 1 ELSE last_day(event_date) END AS DATE)
WHEN regexp_matches(low, '\\b(?:end of (?:the )?week|by friday)\\b') THEN event_date + CAST((5 - dayofweek(event_date) + 7) % 7 AS INTEGER) WHEN regexp_matches(low, '\\b(?:couple of weeks|two weeks)\\b') THEN event_date + 14 WHEN regexp_matches(low, '\\b(?:over the next week|next week|within a week)\\b') THEN event_date + 7
WHEN nextday IS NOT NULL THEN event_date + CAST(CASE WHEN nextday = dayofweek(event_date) THEN 7 ELSE (nextday - dayofweek(event_date) + 7) % 7 END AS INTEGER) WHEN said IS NOT NULL THEN said END AS resolved,
CASE WHEN hard <> '' THEN 'conditional' WHEN len(iso) = 1 OR (regexp_matches(text, '(?i)^(?:w/c|wc|week commencing)\\b') AND len(iso) > 0) THEN 'high' WHEN len(iso) > 1 THEN 'conditional' WHEN regexp_matches(low, '\\b(?:month end|end of (?:the )?month|end of (?:the )?week|by friday)\\b') THEN 'medium'
WHEN regexp_matches(low, '\\b(?:couple of weeks|two weeks|over the next week|next week|within a week)\\b') THEN 'low' WHEN nextday IS NOT NULL OR said IS NOT NULL THEN 'high' ELSE 'none' END AS confidence,
CASE WHEN hard <> '' THEN 'hard stop' WHEN regexp_matches(text, '(?i)^(?:w/c|wc|week commencing)\\b') AND len(iso) > 0 THEN 'monday of the week' WHEN len(iso) = 1 THEN 'one date' WHEN len(iso) > 1 THEN 'last of several dates'
WHEN regexp_matches(low, '\\b(?:month end|end of (?:the )?month)\\b') THEN 'last working day of the month' WHEN regexp_matches(low, '\\b(?:end of (?:the )?week|by friday)\\b') THEN 'friday of the week'
WHEN regexp_matches(low, '\\b(?:couple of weeks|two weeks)\\b') THEN 'two weeks on' WHEN regexp_matches(low, '\\b(?:over the next week|next week|within a week)\\b') THEN 'a week on'
WHEN nextday IS NOT NULL THEN 'next such weekday' WHEN said IS NOT NULL THEN 'weekday of that number' ELSE 'no rule' END AS explanation FROM (
SELECT *, (SELECT min_by(c, o) FROM (VALUES (0), (1), (-1)) t(s), (SELECT 1), LATERAL (SELECT CASE s WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS o, try_cast(strftime(date_trunc('month', event_date) + to_months(s), '%Y-%m-') || lpad(dom, 2, '0') AS DATE) AS c) WHERE c IS NOT NULL AND dayname(c) = upper(wd[1]) || wd[2:]) AS said FROM (
SELECT *, lower(text) AS low, regexp_extract_all(text, '\\b(\\d{4}-\\d{2}-\\d{2})\\b') AS iso, regexp_extract(lower(text), 'hard\\s*stop[^0-9]*(\\d{4}-\\d{2}-\\d{2})', 1) AS hard,
CASE regexp_extract(lower(text), '\\bnext\\s+(sunday|monday|tuesday|wednesday|thursday|friday|saturday)\\b', 1) WHEN 'sunday' THEN 0 WHEN 'monday' THEN 1 WHEN 'tuesday' THEN 2 WHEN 'wednesday' THEN 3 WHEN 'thursday' THEN 4 WHEN 'friday' THEN 5 WHEN 'saturday' THEN 6 END AS nextday,
regexp_extract(lower(text), '\\b(sunday|monday|tuesday|wednesday|thursday|friday|saturday)(?:\\s+the)?\\s+(\\d{1,2})(?:st|nd|rd|th)?\\b', 1) AS wd, regexp_extract(lower(text), '\\b(sunday|monday|tuesday|wednesday|thursday|friday|saturday)(?:\\s+the)?\\s+(\\d{1,2})(?:st|nd|rd|th)?\\b', 2) AS dom FROM v_notes))""")
def resolve_dates(spark, sf):
    return views.notes(spark, sf).select("note_id", T.resolve_date("text", "event_date").alias("r")).select("note_id", F.col("r.date").alias("resolved"), "r.confidence", "r.explanation")


def _redact_sql(c: str) -> str:
    out = c
    for pattern, to in T.SECRETS:
        out = f"regexp_replace({out}, {q(pattern)}, {q(to.replace('$1', chr(92) + '1'))}, 'g')"
    return out


@query(f"SELECT note_id, {_redact_sql('text')} AS text, {_redact_sql('text')} <> text AS redacted FROM v_notes")
def redact_secrets(spark, sf):
    n = views.notes(spark, sf)
    return n.select("note_id", T.redact("text").alias("text"), (T.redact("text") != F.col("text")).alias("redacted"))


# Content that must not leave a workspace.
BOUNDARY = [
    ("windows-drive", r"\b[A-Za-z]:\\[^\s]+"), ("unc-path", r"\\\\[A-Za-z0-9._-]+\\[^\s]+"), ("home-path", r"/(?:home|Users)/[A-Za-z0-9._-]+"), ("office-document", r"\b[\w-]+\.(?:docx|xlsx|pptx|msg)\b"), ("office-base64", r"UEsDB[A-Za-z0-9+/=]{8,}"), ("cloud-path", r"(?i)onedrive - [a-z0-9 ]+|sharepoint\.com/[^\s]+"), ("credential-url", r"https?://[^\s/@]+:[^\s/@]+@"),
]


@query(" UNION ALL ".join(f"SELECT DISTINCT note_id, '{n}' AS rule, unnest(regexp_extract_all(text, {q(p)})) AS finding FROM v_notes" for n, p in BOUNDARY))
def boundary_scan(spark, sf):
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_extract_all("text", F.lit(p), 0).alias("found")) for n, p in BOUNDARY])
    hits = views.notes(spark, sf).select("note_id", F.inline(rules)).select("note_id", "rule", F.explode("found").alias("finding"))
    return hits.distinct()


@query("SELECT d.doc_id, d.source, CAST(1 + (d.n_chars % 2) AS INTEGER) AS version, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS cited, d.n_chars % 2 = 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS stale FROM documents d")
def stale_sources(spark, sf):
    """Every source with its normaliser version (of two; here by parity of its length) and whether a labelled result rests
    on it; one of the old version that nothing rests on is stale."""
    d = views.read(spark, sf, "documents").select("doc_id", "source", (1 + F.col("n_chars") % 2).cast("int").alias("version"))
    cited = views.read(spark, sf, "labels").select("doc_id", F.lit(True).alias("cited")).distinct()
    j = d.join(cited, "doc_id", "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    return j.withColumn("stale", (F.col("version") == 1) & ~F.col("cited"))


VIEW_SQL["v_windows"] = "SELECT source_id, window_seq, window_seq * 4 + 1 AS first_seq, least(window_seq * 4 + 6, last_seq) AS last_seq FROM (SELECT source_id, max(seq) AS last_seq FROM v_segments GROUP BY source_id), LATERAL (SELECT unnest(range(0, CAST(last_seq AS BIGINT))) AS window_seq) r WHERE window_seq * 4 + 1 <= last_seq"


def windows(spark, sf):
    """Windows of six segments that overlap by two."""
    last = views.segments(spark, sf).groupBy("source_id").agg(F.max("seq").alias("last"))
    w = last.withColumn("window_seq", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - 1) / 4))))
    return w.select("source_id", "window_seq", (F.col("window_seq") * 4 + 1).alias("first_seq"), F.least(F.col("window_seq") * 4 + 6, "last").alias("last_seq"))


@query("SELECT s.source_id, s.seq, min(w.window_seq) AS window_seq FROM (SELECT DISTINCT source_id, seq FROM v_segments) s JOIN v_windows w ON s.source_id = w.source_id AND s.seq BETWEEN w.first_seq AND w.last_seq GROUP BY ALL")
def segment_window(spark, sf):
    """First window that covers a segment: windows begin every fourth segment and hold six, so the number tells; no join."""
    s = views.segments(spark, sf).where("source_id IS NOT NULL AND seq >= 1").select("source_id", "seq").distinct()
    return s.select("source_id", "seq", F.greatest(F.lit(0), F.ceil((F.col("seq") - 6) / 4)).cast("long").alias("window_seq"))


#: Tokens of a window, those that the next one repeats, and those of a call with the number of calls that a source may take.
WINDOW, OVERLAP, CALL, CALLS = 500, 60, 1500, 4
_TOKENS = """CASE WHEN words = 0 THEN 0 ELSE CAST(ceil(round(greatest(chars / (4.0 - 1.4 * least(1.0, CAST(marks AS DOUBLE) / chars / 0.2)), words * 1.5 + marks * 0.75, CAST(chars AS DOUBLE) / 4), 9)) AS BIGINT) END"""
_WINDOWS = f"""WITH RECURSIVE t AS (
  SELECT source_id, seq, CAST(length(text) AS DOUBLE) AS chars, len(regexp_extract_all(text, '\\S+')) AS words, len(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}\\s]')) AS marks
  FROM (SELECT conv_id AS source_id, turn + 1 AS seq, coalesce(text, '') AS text FROM conversations)),
s AS (
  SELECT source_id, seq, n, row_number() OVER o - 1 AS i, CAST(sum(n) OVER o - n AS BIGINT) AS p, count(*) OVER (PARTITION BY source_id) AS size
  FROM (SELECT source_id, seq, {_TOKENS} AS n FROM t) WINDOW o AS (PARTITION BY source_id ORDER BY seq)),
e AS (SELECT a.source_id, a.i, max(b.i) AS last FROM s a JOIN s b ON a.source_id = b.source_id AND b.i >= a.i AND (b.i = a.i OR b.p - a.p < {WINDOW}) GROUP BY ALL),
j AS (
  SELECT e.source_id, e.i, e.last, greatest(e.i + 1, coalesce(max(b.i), 0)) AS next
  FROM e JOIN s l ON l.source_id = e.source_id AND l.i = e.last LEFT JOIN s b ON b.source_id = e.source_id AND b.i <= e.last AND l.p + l.n - b.p >= {OVERLAP} GROUP BY e.source_id, e.i, e.last),
w AS (
  SELECT source_id, CAST(0 AS BIGINT) AS window_seq, i, last, next FROM j WHERE i = 0
  UNION ALL SELECT j.source_id, w.window_seq + 1, j.i, j.last, j.next FROM w JOIN s l ON l.source_id = w.source_id AND l.i = w.last AND w.last < l.size - 1 JOIN j ON j.source_id = w.source_id AND j.i = w.next),
v AS (
  SELECT w.source_id, window_seq, f.seq AS first_seq, l.seq AS last_seq, l.p + l.n - f.p AS n_tokens
  FROM w JOIN s f ON f.source_id = w.source_id AND f.i = w.i JOIN s l ON l.source_id = w.source_id AND l.i = w.last)"""


def source_windows(spark, sf):
    """Windows over all segments of all sources."""
    return token_spans.windows(views.segments(spark, sf).select("source_id", "seq", T.token_estimate("text").alias("n")), WINDOW, OVERLAP)


@query(_WINDOWS + " SELECT * FROM v", complete=True)
def token_windows(spark, sf):
    """Overlapping windows of about 500 tokens over the segments of a source."""
    return source_windows(spark, sf).withColumn("window_seq", F.col("window_seq").cast("long"))


@query(_WINDOWS + f""",
c AS (
  SELECT source_id, window_seq, CAST(0 AS BIGINT) AS call_no, n_tokens AS used FROM v WHERE window_seq = 0
  UNION ALL SELECT v.source_id, v.window_seq, CASE WHEN used + v.n_tokens > {CALL} THEN call_no + 1 ELSE call_no END, CASE WHEN used + v.n_tokens > {CALL} THEN 0 ELSE used END + v.n_tokens
  FROM c JOIN v ON v.source_id = c.source_id AND v.window_seq = c.window_seq + 1),
o AS (SELECT source_id, max(call_no) >= {CALLS} OR max(v.n_tokens) > {CALL} AS over_budget FROM c JOIN v USING (source_id, window_seq) GROUP BY source_id)
SELECT source_id, over_budget, call_no, min(window_seq) AS first_window, max(window_seq) AS last_window FROM c JOIN o USING (source_id) GROUP BY ALL""", complete=True)
def call_slices(spark, sf):
    """Consecutive windows packed into calls of at most 1500 tokens; over budget if a window is larger or a source takes over 4 calls."""
    w = materialize(source_windows(spark, sf), "windows")
    calls = materialize(token_spans.calls(w.select("source_id", F.col("window_seq").alias("seq"), F.col("n_tokens").alias("n")), CALL), "calls")
    over = calls.groupBy("source_id").agg((F.max("call_no") >= CALLS).alias("many")).join(w.groupBy("source_id").agg((F.max("n_tokens") > CALL).alias("large")), "source_id")
    long = lambda c: F.col(c).cast("long")
    return calls.join(over, "source_id").select("source_id", (F.col("many") | F.col("large")).alias("over_budget"), long("call_no").alias("call_no"), long("first_seq").alias("first_window"), long("last_seq").alias("last_window"))


#: Words of a unit.
UNIT = 120


def _units_sql() -> str:
    space = T.SPACE
    return f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r?\\n{space}*\\r?\\n'), lambda x: trim(regexp_replace(x, '{space}+', ' ', 'g'))), lambda x: x <> '')) AS para,
  unnest(range(len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r?\\n{space}*\\r?\\n'), lambda x: trim(regexp_replace(x, '{space}+', ' ', 'g'))), lambda x: x <> '')))) AS para_index FROM documents),
p AS (SELECT *, row_number() OVER () AS id, len(string_split(para, ' ')) AS n FROM r),
a AS (SELECT id, unnest(regexp_extract_all(para, '{T.SENTENCE}')) AS part, unnest(range(len(regexp_extract_all(para, '{T.SENTENCE}')))) AS k FROM p WHERE n > {UNIT}),
b AS (SELECT id, part, row_number() OVER (PARTITION BY id ORDER BY k) AS k, len(list_filter(string_split(part, ' '), lambda w: w <> '')) AS n FROM a WHERE trim(part) <> ''),
g AS (
  SELECT id, k, n, part, CAST(0 AS BIGINT) AS unit, n AS used FROM b WHERE k = 1
  UNION ALL SELECT b.id, b.k, b.n, b.part, g.unit + CASE WHEN b.n > {UNIT} OR g.n > {UNIT} OR g.used + b.n > {UNIT} THEN 1 ELSE 0 END, CASE WHEN b.n > {UNIT} OR g.n > {UNIT} OR g.used + b.n > {UNIT} THEN 0 ELSE g.used END + b.n
  FROM g JOIN b ON b.id = g.id AND b.k = g.k + 1),
u AS (
  SELECT id, unit, 0 AS chunk, trim(string_agg(part, '' ORDER BY k)) AS text FROM g WHERE n <= {UNIT} GROUP BY id, unit
  UNION ALL SELECT id, unit, c AS chunk, array_to_string(list_filter(string_split(part, ' '), lambda w: w <> '')[c * {UNIT} + 1:c * {UNIT} + {UNIT}], ' ') FROM (SELECT *, unnest(range(CAST(ceil(n / {UNIT}.0) AS BIGINT))) AS c FROM g WHERE n > {UNIT})
  UNION ALL SELECT id, 0, 0, para FROM p WHERE n <= {UNIT} OR id NOT IN (SELECT id FROM b))
SELECT doc_id, para_index, row_number() OVER (PARTITION BY id ORDER BY unit, chunk) - 1 AS unit_index, CAST(len(string_split(u.text, ' ')) AS BIGINT) AS n_words, u.text FROM u JOIN p USING (id)"""


@query(_units_sql(), complete=True)
def text_units(spark, sf):
    """Units of at most 120 words of every paragraph: whole paragraphs, else sentences in groups, else runs of words."""
    p = views.spread(views.read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.paragraphs("text")).alias("para_index", "para"))
    u = p.select("doc_id", F.col("para_index").cast("long").alias("para_index"), F.posexplode(T.prose_units(F.col("para"), UNIT)).alias("unit_index", "text"))
    return u.select("doc_id", "para_index", F.col("unit_index").cast("long").alias("unit_index"), F.size(F.split("text", " ")).cast("long").alias("n_words"), "text")


@query("""SELECT note_id, CASE WHEN note_id % 5 = 0 THEN event_date WHEN stated <> '' THEN try_cast(stated AS DATE) WHEN compact <> '' THEN try_cast(compact[1:4] || '-' || compact[5:6] || '-' || compact[7:8] AS DATE) END AS event_on,
CASE WHEN note_id % 5 = 0 THEN 'hint' WHEN stated <> '' THEN 'stated' WHEN compact <> '' THEN 'file-name' ELSE 'none' END AS evidence FROM (
SELECT *, regexp_extract(text, '\\b((?:19|20)\\d{2}-\\d{2}-\\d{2})\\b', 1) AS stated, CASE WHEN note_id % 2 = 0 THEN strftime(event_date, '%Y%m%d') ELSE '' END AS compact FROM v_notes)""")
def event_date_evidence(spark, sf):
    """A caller's hint over a date stated in the text over one in the file name; never an invented one."""
    n = views.notes(spark, sf).withColumn("stated", F.regexp_extract("text", r"\b((?:19|20)\d{2}-\d{2}-\d{2})\b", 1))
    n = n.withColumn("file_name", F.concat(F.lit("minutes_"), F.when(F.col("note_id") % 2 == 0, F.date_format("event_date", "yyyyMMdd")).otherwise("undated"), F.lit(".txt")))
    n = n.withColumn("compact", F.regexp_extract("file_name", r"_((?:19|20)\d{6})\b", 1)).withColumn("hint", F.when(F.col("note_id") % 5 == 0, F.col("event_date")))
    date = F.coalesce("hint", F.when(F.col("stated") != "", F.try_to_date("stated")).when(F.col("compact") != "", F.try_to_date("compact", "yyyyMMdd")))
    kind = F.when(F.col("hint").isNotNull(), "hint").when(F.col("stated") != "", "stated").when(F.col("compact") != "", "file-name").otherwise("none")
    return n.select("note_id", date.alias("event_on"), kind.alias("evidence"))
