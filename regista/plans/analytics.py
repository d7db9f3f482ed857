"""Lenses, themes, meeting views and packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regista.functions import texts as T
from regista.operators import mentions, similarity
from regista.operators.graph import components
from regista.plans import reconcile, state, views
from regista.plans.evidence import tokens_sql
from regista.plans.registry import query
from regista.plans.store import materialize
from regista.plans.views import VIEW_SQL

_OPEN = "NOT regexp_matches(lower(status), 'resolved|closed|complete|superseded|rejected|ratified')"
LENSES = [
    ("needsConsultant", "band IN ('Now', 'Soon') AND ownership <> 'customer'", 40), ("needsCustomer", "ownership <> 'unowned' AND NOT (band IN ('Now', 'Soon') AND ownership <> 'customer')", 40), ("topRisksIssues", "register_name = 'Risks_Issues'", 40),
    ("decisionsRequired", "register_name = 'Decisions' AND (contains(lower(status), 'awaiting') OR contains(lower(status), 'pending') OR contains(lower(status), 'proposed'))", 40), ("blockingQuestions", "register_name = 'Open_Questions' AND blocking", 40), ("dueNext", "due_date IS NOT NULL", 40),
    ("challengeNextMeeting", "band IN ('Now', 'Soon')", 10), ("uncertainOrConflicting", "register_name = 'Uncertainty' OR conflict", 40),
]
VIEW_SQL["v_top"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, external_id) AS top FROM v_scored) WHERE top <= 200 AND status IS NOT NULL AND {_OPEN}"
VIEW_SQL["v_two_hundred"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, external_id) AS top FROM v_scored) WHERE top <= 200"
VIEW_SQL["v_lenses"] = " UNION ALL ".join(f"SELECT '{n}' AS lens, {m} AS most, project_id, external_id, due_date, top, score FROM v_top WHERE {w}" for n, w, m in LENSES) + " UNION ALL SELECT 'changesSinceLatestSource', 40, project_id, external_id, due_date, top, score FROM v_two_hundred WHERE latest"


def two_hundred(spark, sf) -> DataFrame:
    """The 200 highest-scoring rows of each project, and whether they are open."""
    w = Window.partitionBy("project_id").orderBy(F.desc("score"), "external_id")
    top = state.scored(spark, sf).withColumn("top", F.row_number().over(w)).where("top <= 200")
    return top.withColumn("is_open", F.coalesce(~F.lower("status").rlike("resolved|closed|complete|superseded|rejected|ratified"), F.lit(False)))


def leading(spark, sf) -> DataFrame:
    """The 200 highest-scoring rows of each project (the cut comes first), then the open ones."""
    return two_hundred(spark, sf).where("is_open").drop("is_open")


def sectioned(rows: DataFrame, sections: list[tuple[str, str, int]]) -> DataFrame:
    """A row for each section whose predicate holds: one scan, an exploded array of structs."""
    hits = F.array(*[F.when(F.expr(w), F.struct(F.lit(n).alias("lens"), F.lit(m).alias("most"))) for n, w, m in sections])
    return rows.select("*", F.inline(F.filter(hits, lambda x: x.isNotNull())))


@query("SELECT project_id, lens, external_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY project_id, lens ORDER BY CASE WHEN lens = 'dueNext' THEN due_date END, top) AS place FROM v_lenses) WHERE place <= most")
def overview_lenses(spark, sf):
    order = Window.partitionBy("project_id", "lens").orderBy(F.when(F.col("lens") == "dueNext", F.col("due_date")), "top")
    lenses = [(n, f"is_open AND ({w})", m) for n, w, m in LENSES] + [("changesSinceLatestSource", "latest", 40)]
    return sectioned(two_hundred(spark, sf), lenses).withColumn("place", F.row_number().over(order)).where("place <= most").select("project_id", "lens", "external_id", "score", "place")


@query("SELECT n_nationkey AS project_id, CASE WHEN n_nationkey % 6 = 0 THEN 'pinned' WHEN c.project_id IS NOT NULL THEN 'changes' WHEN m.project_id IS NOT NULL THEN 'meeting' ELSE 'needs-consultant' END AS lead_mode FROM nation LEFT JOIN (SELECT DISTINCT project_id FROM v_rows JOIN v_ops ON external_id = target_id WHERE op_status = 'pending' AND changeset_id % 50 = project_id) c ON c.project_id = n_nationkey LEFT JOIN (SELECT DISTINCT project_id FROM v_state WHERE register_name = 'Milestones' AND due_date BETWEEN DATE '1998-08-01' AND DATE '1998-08-02') m ON m.project_id = n_nationkey")
def lead_mode(spark, sf):
    """Pinned, else unacknowledged changes, else a milestone today or tomorrow, else the default."""
    n = views.read(spark, sf, "nation").select(F.col("n_nationkey").alias("project_id"))
    o = state.ops(spark, sf).where("op_status = 'pending'")
    c = views.rows(spark, sf).join(o, F.col("external_id") == F.col("target_id")).where("changeset_id % 50 = project_id").select("project_id", F.lit(True).alias("changes")).distinct()
    m = state.current(spark, sf).where("register_name = 'Milestones' AND due_date BETWEEN DATE '1998-08-01' AND DATE '1998-08-02'").select("project_id", F.lit(True).alias("meeting")).distinct()
    j = n.join(c, "project_id", "left").join(m, "project_id", "left")
    return j.select("project_id", F.when(F.col("project_id") % 6 == 0, "pinned").when(F.col("changes"), "changes").when(F.col("meeting"), "meeting").otherwise("needs-consultant").alias("lead_mode"))


_TSTOP = "(" + ", ".join(f"'{s}'" for s in T.THEME_STOP) + ")"
VIEW_SQL["v_titles"] = "SELECT project_id, row_id, coalesce(text, '') AS title, source FROM v_docrows"
VIEW_SQL["v_title_tokens"] = f"SELECT DISTINCT project_id, row_id, unnest(list_distinct({tokens_sql('title', _TSTOP)})) AS token FROM v_titles"
VIEW_SQL["v_token_df"] = "SELECT project_id, token, df, n_rows, df > greatest(3, ceil(0.25 * n_rows)) AS generic FROM (SELECT project_id, token, count(*) AS df FROM v_title_tokens GROUP BY ALL) JOIN (SELECT project_id, count(*) AS n_rows FROM v_docrows GROUP BY 1) USING (project_id)"
VIEW_SQL["v_title_heads"] = f"""SELECT project_id, row_id, min(row_id) OVER (PARTITION BY project_id, toks) AS head
FROM (SELECT project_id, row_id, list_sort(list_distinct({tokens_sql('title', _TSTOP)})) AS toks FROM v_titles) WHERE len(toks) > 0"""
VIEW_SQL["v_head_tokens"] = "SELECT t.* FROM v_title_tokens t JOIN v_title_heads h ON h.row_id = t.row_id AND h.row_id = h.head"
VIEW_SQL["v_title_pairs"] = """SELECT a.project_id, a.row_id AS left_id, b.row_id AS right_id, count(*) AS shared, 2.0 * count(*) / (sa.n + sb.n) AS dice, bool_or(NOT d.generic) AS rare
FROM v_head_tokens a JOIN v_head_tokens b ON a.project_id = b.project_id AND a.token = b.token AND a.row_id < b.row_id
JOIN (SELECT row_id, count(*) AS n FROM v_title_tokens GROUP BY 1) sa ON sa.row_id = a.row_id JOIN (SELECT row_id, count(*) AS n FROM v_title_tokens GROUP BY 1) sb ON sb.row_id = b.row_id
JOIN v_token_df d ON d.project_id = a.project_id AND d.token = a.token GROUP BY a.project_id, a.row_id, b.row_id, sa.n, sb.n"""
VIEW_SQL["v_title_copies"] = """SELECT h.project_id, h.head AS left_id, h.row_id AS right_id, n AS shared, 1.0 AS dice FROM v_title_heads h
JOIN (SELECT t.row_id, count(*) AS n, bool_or(NOT d.generic) AS rare FROM v_title_tokens t JOIN v_token_df d ON d.project_id = t.project_id AND d.token = t.token GROUP BY 1) s ON s.row_id = h.row_id
WHERE h.row_id <> h.head AND n >= 2 AND rare"""
VIEW_SQL["v_every_title_pair"] = VIEW_SQL["v_title_pairs"].replace("v_head_tokens", "v_title_tokens")
VIEW_SQL["v_lexical"] = "SELECT project_id, left_id, right_id, shared, dice FROM v_title_pairs WHERE shared >= 2 AND dice >= 0.6 AND rare UNION ALL SELECT * FROM v_title_copies"


def titles(spark, sf) -> DataFrame:
    """The tables hold no titles of rows, so their whole text stands for one."""
    d = views.doc_rows(spark, sf)
    return d.select("project_id", "row_id", F.coalesce("text", F.lit("")).alias("title"), "source")


def title_tokens(spark, sf) -> DataFrame:
    return views.spread(titles(spark, sf)).select("project_id", "row_id", F.array_distinct(T.tokens("title", T.THEME_STOP)).alias("tokens"))


@query("SELECT * FROM v_token_df")
def token_df(spark, sf):
    """Document frequency of title tokens; a token in over a quarter of a project's rows (three at least) is generic."""
    return frequencies(title_tokens(spark, sf))


def frequencies(t: DataFrame) -> DataFrame:
    n = t.groupBy("project_id").agg(F.count("*").alias("n_rows"))
    df = t.select("project_id", F.explode("tokens").alias("token")).groupBy("project_id", "token").agg(F.count("*").alias("df"))
    return df.join(n, "project_id").select("project_id", "token", "df", "n_rows", (F.col("df") > F.greatest(F.lit(3), F.ceil(F.col("n_rows") * 0.25))).alias("generic"))


def generic_tokens(words: DataFrame) -> DataFrame:
    """(project_id, generic) of title tokens, a row a project. A generic token is in a quarter of a project's rows, so there are
    no more of them than four rows have tokens."""
    return materialize(frequencies(words).where("generic").groupBy("project_id").agg(F.collect_list("token").alias("generic")), "generic")


def alike(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Pairs of heads with two shared tokens or more, Dice of 0.6 or more, and a shared token that isn't generic; and (project_id,
    row_id, head, shared) of all rows, where a head is the least of the rows with the same tokens and ``shared`` their number,
    null if these tokens don't link such rows."""
    words = materialize(title_tokens(spark, sf), "words")
    named = lambda c: F.transform(c, lambda t: F.xxhash64(t))
    weak = F.coalesce(F.array_intersect("tokens", "generic"), F.array().cast("array<string>"))
    t = materialize(words.where(F.size("tokens") > 0).join(F.broadcast(generic_tokens(words)), "project_id", "left").select("project_id", "row_id", named("tokens").alias("tokens"), named(weak).alias("weak")), "titles", **similarity.PACKED)
    heads = materialize(similarity.collapsed(t.withColumn("tokens", F.col("tokens").cast("array<string>"))), "heads")
    pairs = similarity.dice_pairs(t.join(heads.where("row_id = head").select("row_id"), "row_id"), 0.6).where("shared >= 2")
    j = similarity.also_shared(pairs, t.select("row_id", F.col("weak").alias("elements")), "generic").where("shared > generic")
    n = F.size("tokens").cast("long")
    links = t.select("row_id", F.when((n >= 2) & (n > F.size("weak")), n).alias("shared"))
    return j.select("project_id", "left_id", "right_id", F.col("shared").cast("long").alias("shared"), "dice"), heads.join(links, "row_id")


def lexical(spark, sf) -> DataFrame:
    """Links that connect the same titles as all alike pairs do: of rows with the same tokens the least is compared with others,
    the rest are linked to it."""
    near, rows = alike(spark, sf)
    copies = rows.where("row_id <> head AND shared IS NOT NULL")
    return near.unionByName(copies.select("project_id", F.col("head").alias("left_id"), F.col("row_id").alias("right_id"), "shared", F.lit(1.0).alias("dice")))


@query("SELECT project_id, left_id, right_id, shared, round(dice, 6) AS dice FROM v_every_title_pair WHERE shared >= 2 AND dice >= 0.6 AND rare")
def lexical_edges(spark, sf):
    """All pairs of titles that are alike, copies with each of their own and of their partners'."""
    near, rows = alike(spark, sf)
    same = rows.where("row_id = head AND shared IS NOT NULL").select("project_id", F.col("head").alias("left_id"), F.col("head").alias("right_id"), "shared", F.lit(1.0).alias("dice"))
    e = similarity.expanded(near.unionByName(same), rows.select("row_id", "head"))
    return e.select("project_id", F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "shared", F.round("dice", 6).alias("dice"))


@query("SELECT DISTINCT l_partkey AS part_id, hub AS hub_id, l_orderkey AS row_id FROM (SELECT l_partkey, l_orderkey, min(l_orderkey) OVER (PARTITION BY l_partkey) AS hub FROM lineitem) WHERE l_orderkey <> hub")
def theme_edges(spark, sf):
    """Rows of one work package (here a part), linked as a star around the least of them."""
    a = views.anchors(spark, sf).select("part_id", "row_id").distinct()
    hub = a.groupBy("part_id").agg(F.min("row_id").alias("hub_id"))
    return a.join(hub, "part_id").where("row_id <> hub_id").select("part_id", "hub_id", "row_id")


@query("SELECT a.source_id, count(*) AS n_pairs, count(DISTINCT a.row_id) AS n_rows FROM (SELECT DISTINCT source_id, row_id, seq FROM v_anchors) a JOIN (SELECT DISTINCT source_id, row_id, seq FROM v_anchors) b ON a.source_id = b.source_id AND a.row_id < b.row_id AND abs(a.seq - b.seq) <= 6 GROUP BY a.source_id")
def passage_edges(spark, sf):
    """Anchors of one source at most six segments apart, counted without being paired: by place, how many lie before it
    within reach, less those of the same row."""
    a = materialize(views.anchors(spark, sf).select("source_id", "row_id", "seq").distinct(), "anchors")
    places = _within(a.groupBy("source_id", "seq").agg(F.count("*").alias("c"), F.max("row_id").alias("most")))
    by = Window.partitionBy("source_id", "block").orderBy("seq")
    near = F.coalesce(F.sum("c").over(by.rangeBetween(-RADIUS, -1)), F.lit(0))
    places = places.withColumns({"pairs": F.col("c") * near + F.floor(F.col("c") * (F.col("c") - 1) / 2), "reach": F.max("most").over(by.rangeBetween(-RADIUS, RADIUS))}).where("own")
    own = F.count("*").over(Window.partitionBy("source_id", "row_id").orderBy("seq").rangeBetween(-RADIUS, -1))  # a row's own anchors in one source
    same = a.withColumn("own", own).groupBy("source_id").agg(F.sum("own").alias("same"))
    pairs = places.groupBy("source_id").agg(F.sum("pairs").alias("pairs")).join(same, "source_id")
    rows = a.join(places.select("source_id", "seq", "reach"), ["source_id", "seq"]).where("row_id < reach").groupBy("source_id").agg(F.count_distinct("row_id").alias("n_rows"))
    return pairs.join(rows, "source_id").select("source_id", (F.col("pairs") - F.col("same")).alias("n_pairs"), "n_rows")


#: Segments that a passage reaches, and segments of a source that one task looks at.
RADIUS, SPAN = 6, 4096


def _within(rows):
    """``rows`` (source_id, seq) by blocks of segments that see what lies within reach on both sides."""
    at = lambda d: F.floor((F.col("seq") + d) / SPAN)
    return rows.withColumn("block", F.explode(F.array_distinct(F.array(at(0), at(-RADIUS), at(RADIUS))))).withColumn("own", F.col("block") == at(0))


@query("""SELECT DISTINCT source_id, least(row_id, before) AS left_id, greatest(row_id, before) AS right_id FROM (
  SELECT source_id, row_id, seq, lag(row_id) OVER o AS before, lag(seq) OVER o AS last FROM (SELECT DISTINCT source_id, row_id, seq FROM v_anchors) WINDOW o AS (PARTITION BY source_id ORDER BY seq, row_id))
WHERE row_id <> before AND seq - last <= 6""")
def passage_links(spark, sf):
    """Links that connect the same rows as all pairs within reach do: each anchor with the one before it, as whatever lies
    between two anchors within reach is within reach of both. One link an anchor, however many share a passage."""
    a = _within(views.anchors(spark, sf).select("source_id", "row_id", "seq").distinct())
    by = Window.partitionBy("source_id", "block").orderBy("seq", "row_id")
    j = a.withColumns({"before": F.lag("row_id").over(by), "last": F.lag("seq").over(by)}).where((F.col("row_id") != F.col("before")) & (F.col("seq") - F.col("last") <= RADIUS))
    return j.select("source_id", F.least("row_id", "before").alias("left_id"), F.greatest("row_id", "before").alias("right_id")).distinct()


@query("""WITH r AS (SELECT project_id, external_id AS id, related_id, supersedes_id, external_id IN (SELECT supersedes_id FROM v_rows WHERE supersedes_id IS NOT NULL) AS superseded FROM v_rows)
SELECT DISTINCT project_id, kind, least(id, other) AS left_id, greatest(id, other) AS right_id FROM (
  SELECT project_id, id, 'related-id' AS kind, related_id AS other FROM r WHERE NOT superseded UNION ALL SELECT project_id, id, 'supersession', supersedes_id FROM r WHERE NOT superseded) e
WHERE id <> other AND EXISTS (SELECT 1 FROM r WHERE r.project_id = e.project_id AND r.id = e.other)""")
def record_edges(spark, sf):
    """Links that open rows state themselves, to rows of their project: a related record, one that they supersede."""
    r = materialize(views.rows(spark, sf).select("project_id", F.col("external_id").alias("id"), "related_id", "supersedes_id"), "records")
    past = r.select(F.col("supersedes_id").alias("id")).where("id IS NOT NULL").distinct()
    said = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("other")) for k, c in (("related-id", "related_id"), ("supersession", "supersedes_id"))])
    links = r.join(past, "id", "left_anti").select("project_id", "id", F.inline(said)).where("id <> other")
    known = links.join(r.select("project_id", F.col("id").alias("other")), ["project_id", "other"])
    return known.select("project_id", "kind", F.least("id", "other").alias("left_id"), F.greatest("id", "other").alias("right_id")).distinct()


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
VIEW_SQL["v_names"] = f"SELECT DISTINCT array_to_string({_WORDS.format(c='text')}[1:2], ' ') AS name FROM benchmark WHERE len({_WORDS.format(c='text')}) > 0"
VIEW_SQL["v_worded"] = f"SELECT lang AS project_id, doc_id AS row_id, {_WORDS.format(c='text')} AS words FROM documents"
VIEW_SQL["v_cutoff"] = "SELECT project_id, CAST(greatest(3, ceil(count(*) * 0.25)) AS BIGINT) AS most FROM v_worded GROUP BY project_id"


@query("""WITH f AS (SELECT project_id, word, count(*) AS df FROM (SELECT project_id, unnest(list_distinct(words)) AS word FROM v_worded) GROUP BY ALL),
n AS (SELECT DISTINCT c.project_id, n.name, c.most FROM v_names n, v_cutoff c, LATERAL (SELECT unnest(string_split(n.name, ' ')) AS word) w LEFT JOIN f ON f.project_id = c.project_id AND f.word = w.word
  WHERE length(w.word) > 2 AND coalesce(f.df, 0) < c.most),
m AS (SELECT n.project_id, n.name, n.most, w.row_id FROM n JOIN v_worded w ON w.project_id = n.project_id AND contains(' ' || array_to_string(w.words, ' ') || ' ', ' ' || n.name || ' ')),
s AS (SELECT *, count(*) OVER (PARTITION BY project_id, name) AS n, min(row_id) OVER (PARTITION BY project_id, name) AS left_id FROM m)
SELECT project_id, name, left_id, row_id AS right_id FROM s WHERE n BETWEEN 2 AND most AND row_id <> left_id""")
def entity_edges(spark, sf):
    """Rows that name the same entity, linked to the first of them. Names are the leading two words of the benchmark's items;
    a name counts if one of its words (three characters or more) is in fewer rows than the project's cut-off, and links if
    two rows or more, and no more than the cut-off, mention it as whole words."""
    rows = materialize(views.spread(views.read(spark, sf, "documents")).select(F.col("lang").alias("project_id"), F.col("doc_id").alias("row_id"), mentions.words("text").alias("words")), "worded")
    most = rows.groupBy("project_id").agg(F.greatest(F.lit(3), F.ceil(F.count("*") * 0.25)).cast("long").alias("most"))
    names = views.read(spark, sf, "benchmark").select(F.array_join(F.slice(mentions.words("text"), 1, 2), " ").alias("name")).where("name <> ''").distinct()
    df = rows.select("project_id", F.explode(F.array_distinct("words")).alias("word")).groupBy("project_id", "word").agg(F.count("*").alias("df"))
    # a name that a project mentions has all its words there, so it is enough to look at words that the project has
    spelled = names.select("name", F.explode(F.split("name", " ")).alias("word")).where(F.length("word") > 2)
    usable = df.join(most, "project_id").where("df < most").join(spelled, "word").select("project_id", "name").distinct()
    return mentions.stars(mentions.mentions(rows, usable), 2, most)


VIEW_SQL["v_reach"] = "SELECT DISTINCT a AS node, b AS reach FROM (SELECT left_id AS a, right_id AS b FROM v_lexical UNION ALL SELECT right_id, left_id FROM v_lexical)"
def themes(spark, sf) -> DataFrame:
    """(row_id, root) of rows that similar titles connect; root is the smallest id."""
    return components(lexical(spark, sf).select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"))).select(F.col("node").alias("row_id"), "root")


@query(name="components")
def components_of_rows(spark, sf):
    return themes(spark, sf)


def _recursive(body: str) -> str:
    from regista.plans.registry import with_views

    return with_views("SELECT node, reach FROM v_reach").replace("\nSELECT node, reach FROM v_reach", "").replace("WITH ", "WITH RECURSIVE ", 1) + ",\nclosure AS (SELECT node, reach FROM v_reach UNION SELECT c.node, r.reach FROM closure c JOIN v_reach r ON c.reach = r.node),\nrooted AS (SELECT node AS row_id, least(node, min(reach)) AS root FROM closure GROUP BY node)\n" + body


def _register_recursive() -> None:
    from regista.plans.registry import ORACLES

    ORACLES["components"] = _recursive("SELECT row_id, root FROM rooted")
    ORACLES["theme_summary"] = _recursive("SELECT t.project_id, r.root, count(*) AS n_members, count(DISTINCT t.source) AS n_sources, min(r.row_id) AS first_id, max(r.row_id) AS last_id, count_if(r.row_id % 4 = 0) AS n_closed, string_agg(r.row_id, ',' ORDER BY r.row_id) AS members FROM rooted r JOIN v_titles t ON t.row_id = r.row_id GROUP BY ALL")
    ORACLES["theme_label"] = _recursive("SELECT root, coalesce(label, CAST(first_id AS VARCHAR) || ' and ' || (n - 1) || ' related record' || CASE WHEN n = 2 THEN '' ELSE 's' END) AS label FROM (SELECT root, min(row_id) AS first_id, count(*) AS n FROM rooted GROUP BY root) LEFT JOIN (SELECT root, string_agg(token, ' / ' ORDER BY k) AS label FROM (SELECT root, token, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, token) AS k FROM rooted JOIN v_title_tokens USING (row_id) JOIN v_token_df d USING (project_id, token) WHERE NOT d.generic GROUP BY root, token HAVING count(*) >= 2) WHERE k <= 2 GROUP BY root) USING (root)")
    ORACLES["unlock_count"] = _recursive("SELECT row_id, root, count_if(row_id % 4 <> 0 AND row_id % 9 <> 0) OVER (PARTITION BY root) - CASE WHEN row_id % 4 <> 0 AND row_id % 9 <> 0 THEN 1 ELSE 0 END AS unlocks FROM rooted")


@query()
def theme_summary(spark, sf):
    """Aggregates of each theme (every fourth row counts as closed here)."""
    j = themes(spark, sf).join(titles(spark, sf), "row_id")
    members = F.array_join(F.array_sort(F.collect_list("row_id")), ",")
    return j.groupBy("project_id", "root").agg(F.count("*").alias("n_members"), F.count_distinct("source").alias("n_sources"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"), F.count_if(F.col("row_id") % 4 == 0).alias("n_closed"), members.alias("members"))


@query()
def theme_label(spark, sf):
    """The two most frequent distinctive title tokens that two members share, else a plain statement."""
    t = materialize(themes(spark, sf), "themes")
    words = materialize(title_tokens(spark, sf), "words")
    rare = F.when(F.col("generic").isNull(), F.col("tokens")).otherwise(F.array_except("tokens", "generic"))
    members = words.where("project_id IS NOT NULL").join(t, "row_id").join(F.broadcast(generic_tokens(words)), "project_id", "left")
    counts = members.select("root", F.explode(rare).alias("token")).groupBy("root", "token").agg(F.count("*").alias("c")).where("c >= 2")
    k = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("c"), "token"))
    label = counts.withColumn("k", k).where("k <= 2").groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda x: x["token"]), " / ").alias("label"))
    n = t.groupBy("root").agg(F.min("row_id").alias("first_id"), F.count("*").alias("n"))
    plain = F.concat(F.col("first_id").cast("string"), F.lit(" and "), (F.col("n") - 1).cast("string"), F.lit(" related record"), F.when(F.col("n") == 2, "").otherwise("s"))
    return n.join(label, "root", "left").select("root", F.coalesce("label", plain).alias("label"))


@query()
def unlock_count(spark, sf):
    """Open peers of a row's theme that are no decisions (every fourth row is closed, every ninth a decision here)."""
    open_ = (F.col("row_id") % 4 != 0) & (F.col("row_id") % 9 != 0)
    t = materialize(themes(spark, sf), "themes")
    n = t.groupBy("root").agg(F.count_if(open_).alias("n"))
    return t.join(n, "root").select("row_id", "root", (F.col("n") - open_.cast("int")).alias("unlocks"))


_register_recursive()

SECTIONS = [
    ("overdue", "due_days < 0", 12), ("decide", "register_name = 'Decisions'", 12), ("unblock", "blocking", 12), ("risks", "register_name = 'Risks_Issues'", 12), ("unowned", "ownership = 'unowned'", 12), ("changed", "latest", 12), ("dueSoon", "due_days BETWEEN 0 AND 14", 24),
]
VIEW_SQL["v_sections"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, lens ORDER BY score DESC, external_id) AS place FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS lens, {m} AS most, project_id, external_id, score, title, band FROM v_scored WHERE NOT closed AND {w}" for n, w, m in SECTIONS) + ")) WHERE place <= most"


def sections(spark, sf) -> DataFrame:
    order = Window.partitionBy("project_id", "lens").orderBy(F.desc("score"), "external_id")
    return sectioned(state.scored(spark, sf).where("NOT closed"), SECTIONS).withColumn("place", F.row_number().over(order)).where("place <= most")


@query("SELECT project_id, lens, external_id, place FROM v_sections")
def view_sections(spark, sf):
    return sections(spark, sf).select("project_id", "lens", "external_id", "place")


VIEW_SQL["v_pack"] = "SELECT project_id, count(*) AS n_records, md5(string_agg(external_id || ':' || score, ',' ORDER BY place)) AS pack_hash FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, external_id) AS place FROM (SELECT DISTINCT project_id, external_id, score FROM v_sections)) WHERE place <= 40 GROUP BY project_id"


def packs(spark, sf) -> DataFrame:
    order = Window.partitionBy("project_id").orderBy(F.desc("score"), "external_id")
    p = sections(spark, sf).select("project_id", "external_id", "score").distinct().withColumn("place", F.row_number().over(order)).where("place <= 40")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "external_id", "score"))), lambda x: F.concat_ws(":", x["external_id"].cast("string"), x["score"].cast("string")))
    return p.groupBy("project_id").agg(F.count("*").alias("n_records"), F.md5(F.array_join(listed, ",").cast("binary")).alias("pack_hash"))


@query("SELECT * FROM v_pack")
def selection_pack(spark, sf):
    """The 40 leading distinct records of a project's sections, and a hash of the selection."""
    return packs(spark, sf)


@query("SELECT project_id, CASE WHEN project_id % 3 = 0 THEN 'stale' WHEN project_id % 4 = 0 THEN 'revived' ELSE 'fresh' END AS view_state, CASE WHEN project_id % 3 = 0 THEN 'selection changed' END AS reason FROM v_pack")
def view_staleness(spark, sf):
    """Cached views against the current selection: every third cache holds another hash, every fourth was marked stale."""
    p = packs(spark, sf)
    cached = p.select("project_id", F.when(F.col("project_id") % 3 == 0, F.md5(F.col("pack_hash").cast("binary"))).otherwise(F.col("pack_hash")).alias("cached"), (F.col("project_id") % 4 == 0).alias("was_stale"))
    j = p.join(cached, "project_id")
    changed = F.col("cached") != F.col("pack_hash")
    return j.select("project_id", F.when(changed, "stale").when(F.col("was_stale"), "revived").otherwise("fresh").alias("view_state"), F.when(changed, "selection changed").alias("reason"))


@query("SELECT p.project_id, s.lens, coalesce(string_agg(x.title || ' (' || x.band || ')', '; ' ORDER BY x.place), 'Nothing here.') AS line, count(x.external_id) AS n_records FROM (SELECT DISTINCT project_id FROM v_rows) p CROSS JOIN (SELECT unnest(['overdue','decide','unblock','risks','unowned','changed']) AS lens) s LEFT JOIN (SELECT * FROM v_sections WHERE place <= 6) x ON x.project_id = p.project_id AND x.lens = s.lens GROUP BY p.project_id, s.lens")
def brief_lines(spark, sf):
    """Six sections of at most six records; an empty section says so."""
    names = [n for n, _, _ in SECTIONS[:6]]
    want = views.rows(spark, sf).select("project_id").distinct().withColumn("lens", F.explode(F.array(*map(F.lit, names))))
    x = sections(spark, sf).where("place <= 6")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "title", "band"))), lambda r: F.concat(r["title"], F.lit(" ("), r["band"], F.lit(")")))
    g = x.groupBy("project_id", "lens").agg(F.array_join(listed, "; ").alias("line"), F.count("*").alias("n_records"))
    return want.join(g, ["project_id", "lens"], "left").select("project_id", "lens", F.coalesce("line", F.lit("Nothing here.")).alias("line"), F.coalesce("n_records", F.lit(0)).alias("n_records"))
