"""Text functions as column expressions: folding, tokens, token estimate, markers, dates, redaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no evidence, by use.
EVIDENCE_STOP = "a an and are as at be been but by for from had has have in into is it its of on or that the their them then there they this to was were will with you your".split()
THEME_STOP = EVIDENCE_STOP + "we our not can should need needs must may about after before when which who what how".split()
GRADE_STOP = "a an and are as be by for from in into is it of on or rather should the to use with".split()

# Wording of governance markers, on folded text.
COMMITMENT_CUE = r"\b(?:i(?:'ll| will| shall| need to| have to| must| am going to| ?'m going to)|we(?:'ll| will| shall| need to| should| must| have to| are going to| ?'re going to)|you(?:'ll| will| need to| must)|(?:they|he|she)(?:'ll| will| must)|let me|let us|can you|could you|please|action|deadline|due|target|by then|before|no later than|promise[sd]?|committed to|commit to|undertake[sd]?|undertaking to)\b"
PAST_TIME = r"\b(?:last (?:week|month|year|time|night|monday|tuesday|wednesday|thursday|friday|saturday|sunday)|yesterday|the other day|previously|earlier (?:this|last) (?:week|month|year)|(?:a|an|one|two|three|four|five|six|seven|eight|nine|ten|\d+) (?:day|days|week|weeks|month|months|year|years) ago|back in (?:january|february|march|april|may|june|july|august|september|october|november|december))\b"
HYPOTHETICAL = r"\b(?:would have|could have|should have|might have|used to|if we had|if i had|had we|hypothetically)\b"
FUTURE_MODAL = r"\b(?:i(?:'ll| will| shall| ?'m going to| am going to)|we(?:'ll| will| shall| ?'re going to| are going to)|you(?:'ll| will)|(?:they|he|she)(?:'ll| will)|will|shall|going to|needs? to|must|have to|has to|no later than|by then)\b"
CLAUSE_BOUNDARY = r"[.!?;,]+|\b(?:but|however|whereas|although|though|unlike|because|even if)\b"
DATE_PHRASE = r"\b(?:by (?:the )?end of (?:the )?(?:week|month|day)|by (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)|next (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|week|month)|\d{4}-\d{2}-\d{2}|\d{1,2}(?:st|nd|rd|th) (?:of )?(?:january|february|march|april|may|june|july|august|september|october|november|december))\b"
SCHEDULED_TIME = r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b[^.?!]{0,40}\b(?:\d{1,2}(?:st|nd|rd|th)|\d{1,2}[:.]\d{2}|\d{1,2} ?(?:am|pm)|(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve) o'clock)\b"
CONFIG_OBJECT = r"\b(?:box|tick ?box|checkbox|field|setting|settings|config|configuration|flag|option|value|template|permit|permits|register|record|records|status|toggle|parameter|rule|workflow|form|screen|profile|role|permission|module)\b"
SYSTEM_VERB = r"\b(?:tick|ticked|untick|unticked|suppress|suppressed|configure|configured|rename|renamed|enable|enabled|disable|disabled)\b"
LIVE_ACT = r"\b(?:i(?:'ll|'ve| have| just| will| am going to)|let me|we've|we have)\b.{0,80}?\b(?:add|added|change|changed|tick|ticked|save|saved|suppress|suppressed|configure|configured|rename|renamed|remove|removed|switch|switched|enable|enabled|disable|disabled)\b"
EXPLICIT_ACTION = r"\b(?:that's an action|action (?:on|for) (?:me|us|you|yourselves)|i(?:'ll|'ve| will| have| need to| am going to| just)(?: \w+){0,3} (?:check|confirm|send|update|add|added|remove|create|suppress|tick|chase|raise|book|arrange|set up|come back|follow up))\b"
EXPLICIT_REGISTER = r"\b(?:capture|record|add|note|log)(?: that| this| it)? (?:for|to|in|as|against) (?:the )?(?:decision|action|risk|issue|question|register|log|backlog|development)\b|\b(?:ai note|note for development|for the register|for the log|one for the register)\b"
COMMITMENT = r"\b(?:we need to|i need to think|i(?:'ll| will) come back|i(?:'ll| will) check|we should probably|somebody needs to)\b"
QUESTION = r"\?\s*$"
CONSTRAINT = r"\b(?:can only|cannot|can't|isn't able|doesn't support|not able to|limited to|no way to)\b"
LEXICAL = r"\b(?:risk|question|issue|concern|assumption|dependency|blocker)\b"

# What counts as a secret, in the order of replacement.
SECRETS = [
    (r"(https?://)[^\s/@]+:[^\s/@]+@", r"$1***:***@"),
    (r"(?i)(\"?(?:access_token|refresh_token|client_secret|password|authorization)\"?\s*[:=]\s*\"?)[^\"\s,}]+", r"$1***"),
    (r"gh[pousr]_[A-Za-z0-9]{16,}", "***"),
    (r"github_pat_[A-Za-z0-9_]{20,}", "***"),
    (r"ya29\.[A-Za-z0-9._-]{20,}", "***"),
    (r"\b1//[A-Za-z0-9._-]{20,}", "***"),
]

# Kinds of failure by error text, in order of precedence.
FAILURES = [
    ("cli-missing", r"command not found|is not recognized as an internal or external command|no such file or directory|executable file not found|cannot find the path|not installed"),
    ("cli-too-old", r"requires a newer|requires at least version|newer version of the|please (?:update|upgrade)|upgrade your|update your |unsupported (?:cli|client) version|client (?:is )?too old|outdated (?:cli|client)"),
    ("model-unsupported", r"(?:unknown|unsupported|invalid|unrecognized|unavailable)[^\n]{0,40}model|model[^\n]{0,60}(?:not found|not supported|not available|not enabled|does not exist|is invalid|is unknown)|model_not_found|does not have access to model"),
    ("auth", r"\b40[13]\b|unauthori[sz]ed|unauthenticated|not logged in|not signed in|please (?:run )?(?:codex |claude )?login|authentication failed|invalid api key|missing api key|no api key|credentials?|token (?:has )?expired|forbidden|sign in to"),
    ("transient", r"\b(?:408|429|500|502|503|504)\b|rate limit|too many requests|timed out|timeout|temporarily unavailable|service unavailable|econnreset|econnrefused|etimedout|enotfound|epipe|socket hang up|network error|overloaded|try again later|stream (?:disconnected|interrupted)"),
]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used: plain columns would be written out again at
    each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold(text: str | Column) -> Column:
    """Quotes and dashes made plain, lower case, white space (of any kind) collapsed and trimmed."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.translate(F.coalesce(text, F.lit("")), "‘’‚‛′“”„‟″‐‑‒–—―−", "'''''\"\"\"\"\"-------")
    return F.trim(F.regexp_replace(F.lower(plain), r"(?U)\s+", " "))


def tokens(text: str | Column, stop: list[str] = EVIDENCE_STOP) -> Column:
    """Words of a folded text with content: three characters or more, not in the stop list, in order."""
    plain = F.split(F.regexp_replace(fold(text), "[^a-z0-9]+", " "), " ")
    return F.filter(plain, lambda t: (F.length(t) > 2) & ~t.isin(stop))


def token_estimate(text: str | Column) -> Column:
    """Model tokens a text takes: by characters (fewer to a token the denser the punctuation), by words, and at least a quarter of the characters."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    chars = F.length(text)
    words = F.regexp_count(text, F.lit(r"(?U)\S+"))
    marks = F.regexp_count(text, F.lit(r"(?U)[^\p{L}\p{N}\s]"))
    per = F.lit(4.0) - F.lit(1.4) * F.least(F.lit(1.0), marks / chars / F.lit(0.2))
    most = F.greatest(chars / per, words * 1.5 + marks * 0.75, chars / 4)
    return F.when(words == 0, 0).otherwise(F.ceil(F.round(most, 9))).cast("long")


def first_clause(folded: Column, pattern: str) -> Column:
    """The clause that holds the first match, or the whole text where a boundary falls inside it."""
    return F.coalesce(F.get(F.filter(F.split(folded, CLAUSE_BOUNDARY), lambda c: c.rlike(pattern)), F.lit(0)), folded)


def commits(folded: Column, pattern: str) -> Column:
    """Whether the date phrase is committed to: a future modal in its clause decides, else past or hypothetical wording vetoes."""
    clause = first_clause(folded, pattern)
    return clause.rlike(FUTURE_MODAL) | ~(clause.rlike(PAST_TIME) | clause.rlike(HYPOTHETICAL))


def markers(text: str | Column) -> Column:
    """Array of (marker_type, confidence, matched) of a segment, at most one of a type."""
    return let(fold(text), markers_of_folded)


def markers_of_folded(f: Column) -> Column:
    date = f.rlike(DATE_PHRASE) & f.rlike(COMMITMENT_CUE) & commits(f, DATE_PHRASE)
    time = f.rlike(SCHEDULED_TIME) & commits(f, SCHEDULED_TIME)
    act = f.rlike(LIVE_ACT) & (f.rlike(CONFIG_OBJECT) | F.regexp_extract(f, LIVE_ACT, 0).rlike(SYSTEM_VERB))
    found = [
        ("explicit-action", "high", EXPLICIT_ACTION, f.rlike(EXPLICIT_ACTION)), ("explicit-register", "high", EXPLICIT_REGISTER, f.rlike(EXPLICIT_REGISTER)), ("explicit-date", "high", DATE_PHRASE, date),
        ("scheduled-time", "high", SCHEDULED_TIME, time), ("live-config-act", "high", LIVE_ACT, act), ("commitment-pattern", "medium", COMMITMENT, f.rlike(COMMITMENT)),
        ("question-pattern", "medium", QUESTION, f.rlike(QUESTION)), ("constraint-pattern", "medium", CONSTRAINT, f.rlike(CONSTRAINT)), ("lexical", "low", LEXICAL, f.rlike(LEXICAL)),
    ]
    one = lambda name, level, pattern, when: F.when(when, F.struct(F.lit(name).alias("marker_type"), F.lit(level).alias("confidence"), F.regexp_extract(f, pattern, 0).alias("matched")))
    return F.filter(F.array(*[one(*x) for x in found]), lambda m: m.isNotNull())


_DAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]


def last_working_day(day: Column) -> Column:
    end = F.last_day(day)
    back = F.when(F.dayofweek(end) == 1, 2).when(F.dayofweek(end) == 7, 1).otherwise(0)
    return F.date_sub(end, back)


def resolve_date(text: str | Column, event: str | Column) -> Column:
    """(date, confidence, explanation) that a wording stands for, relative to an event's date; never an invented date."""
    text = F.trim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    event = F.col(event) if isinstance(event, str) else event
    both = F.struct(text.alias("text"), F.lower(F.regexp_replace(text, r"\s+", " ")).alias("low"))
    return let(both, lambda b: let(date_facts(b["text"], b["low"]), lambda f: dated(b["text"], b["low"], f, event)))


# Wordings of dates.
WEEKDAY = "sunday|monday|tuesday|wednesday|thursday|friday|saturday"
HARD_STOP = r"hard\s*stop[^0-9]*(\d{4}-\d{2}-\d{2})"
WEEK_COMMENCING = r"(?i)^(?:w/c|wc|week commencing)\b"
MONTH_END = r"\b(?:month end|end of (?:the )?month)\b"
WEEK_END = r"\b(?:end of (?:the )?week|by friday)\b"
TWO_WEEKS = r"\b(?:couple of weeks|two weeks)\b"
A_WEEK = r"\b(?:over the next week|next week|within a week)\b"
UPCOMING = rf"\bnext\s+({WEEKDAY})\b"
NUMBERED = rf"\b({WEEKDAY})(?:\s+the)?\s+(\d{{1,2}})(?:st|nd|rd|th)?\b"


def date_facts(text: Column, low: Column) -> Column:
    """What a wording holds that dates are made of."""
    iso = F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), 1)
    number = lambda name: F.coalesce(*[F.when(name == d, i) for i, d in enumerate(_DAYS)])
    return F.struct(
        F.size(iso).alias("n"), F.try_to_date(F.get(iso, F.lit(0))).alias("first"), F.try_to_date(F.try_element_at(iso, F.lit(-1))).alias("last"),
        F.regexp_extract(low, HARD_STOP, 1).alias("hard"), number(F.regexp_extract(low, UPCOMING, 1)).alias("upcoming"),
        number(F.regexp_extract(low, NUMBERED, 1)).alias("weekday"), F.regexp_extract(low, NUMBERED, 2).try_cast("int").alias("day"),
    )


def dated(text: Column, low: Column, f: Column, event: Column) -> Column:
    """The first rule that holds."""
    first, last, day = f["first"], f["last"], f["day"]
    ahead = (f["upcoming"] - (F.dayofweek(event) - 1) + 7) % 7
    tries = []
    for shift in (0, 1, -1):
        month = F.trunc(F.add_months(event, shift), "MM")
        fits = (day >= 1) & (day <= F.dayofmonth(F.last_day(month))) & (F.dayofweek(F.date_add(month, day - 1)) == f["weekday"] + 1)
        tries.append(F.when(fits, F.date_add(month, day - 1)))
    said = F.coalesce(*tries)
    out = lambda date, level, why: F.struct(date.cast("date").alias("date"), F.lit(level).alias("confidence"), F.lit(why).alias("explanation"))
    none = lambda why: out(F.lit(None), "none", why)
    return (
        F.when(text == "", none("no wording")).when(f["hard"] != "", out(F.try_to_date(f["hard"]), "conditional", "hard stop"))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), out(first, "exact", "a date"))
        .when(text.rlike(WEEK_COMMENCING) & first.isNotNull(), out(F.date_sub(first, (F.dayofweek(first) + 5) % 7), "high", "monday of the week"))
        .when(f["n"] == 1, out(first, "high", "one date")).when(f["n"] > 1, out(last, "conditional", "last of several dates")).when(event.isNull(), none("no date to count from"))
        .when(low.rlike(MONTH_END), out(last_working_day(event), "medium", "last working day of the month")).when(low.rlike(WEEK_END), out(F.next_day(F.date_sub(event, 1), "FR"), "medium", "friday of the week"))
        .when(low.rlike(TWO_WEEKS), out(F.date_add(event, 14), "low", "two weeks on")).when(low.rlike(A_WEEK), out(F.date_add(event, 7), "low", "a week on"))
        .when(f["upcoming"].isNotNull(), out(F.date_add(event, F.when(ahead == 0, 7).otherwise(ahead).cast("int")), "high", "next such weekday"))
        .when(said.isNotNull(), out(said, "high", "weekday of that number")).otherwise(none("no rule"))
    )


def redact(text: str | Column) -> Column:
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for pattern, to in SECRETS:
        text = F.regexp_replace(text, pattern, to)
    return text


def failure_kind(text: str | Column) -> Column:
    text = F.lower(F.col(text) if isinstance(text, str) else text)
    out = F.lit("unknown")
    for kind, pattern in reversed(FAILURES):
        out = F.when(text.rlike(pattern), kind).otherwise(out)
    return out


def strip_markup(html: str | Column) -> Column:
    """Text of markup: tags out, the common entities decoded, white space collapsed."""
    html = F.regexp_replace(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")), "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(html, r"[ \t\r\n]+", " "))


#: What counts as white space in prose, as a class of a pattern.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: A sentence with its marks and the space after it.
SENTENCE = "[^.!?…]+[.!?…]* *"


def paragraphs(text: str | Column) -> Column:
    """The paragraphs of a text, parted by blank lines, white space collapsed; those of white space only are left out."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    plain = F.transform(F.split(text, rf"\r?\n{SPACE}*\r?\n"), lambda p: F.trim(F.regexp_replace(p, f"{SPACE}+", " ")))
    return F.filter(plain, lambda p: p != "")


def prose_units(paragraph: Column, most: int = 120) -> Column:
    """Units of at most ``most`` words of a paragraph (collapsed): the paragraph if it is short enough, else its sentences,
    gathered in order as long as they fit; a longer sentence is cut between words. Units put together are the paragraph, but
    for marks that come before its first sentence."""
    words = lambda t: F.size(F.filter(F.split(t, " "), lambda w: w != ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))

    def cut(part: Column) -> Column:
        tokens = F.filter(F.split(part, " "), lambda w: w != "")
        return F.transform(F.sequence(F.lit(1), F.size(tokens), F.lit(most)), lambda i: F.array_join(F.slice(tokens, i, F.lit(most)), " "))

    def state(done: Column, held: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), held.alias("held"), n.cast("int").alias("n"))

    def add(acc: Column, part: Column) -> Column:
        n = words(part)
        kept = F.when(acc["n"] > 0, F.concat(acc["done"], F.array(F.trim(acc["held"])))).otherwise(acc["done"])
        return F.when(n == 0, acc).when(n > most, state(F.concat(kept, cut(part)), F.lit(""), F.lit(0))).when((acc["n"] > 0) & (acc["n"] + n > most), state(kept, part, n)).otherwise(state(acc["done"], F.concat(acc["held"], part), acc["n"] + n))

    parts = F.regexp_extract_all(paragraph, F.lit(f"({SENTENCE})"))
    gathered = F.aggregate(parts, start, add, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(F.trim(acc["held"])))).otherwise(acc["done"]))
    return F.when(words(paragraph) <= most, F.array(paragraph)).otherwise(let(gathered, lambda units: F.when(F.size(units) > 0, units).otherwise(F.array(paragraph))))
