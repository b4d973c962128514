"""Personal data by patterns, checksums and context, in DataFrame functions (operator 3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import whole_text

#: Kinds in the order in which spans with one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Patterns take runs of characters whole (possessive) and start only where a run starts.
#: That changes no match, as nothing inside a run can start or end one, but keeps the time
#: and the stack that a long run takes from growing with its square.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # After a match (\G) the next may start inside such a run.
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Score of a confirmed span, and what a context word shortly before it adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
CONTEXT_BONUS = 0.1
SSN_BONUS = 0.4
CONTEXT_CHARS = 40
CONTEXT = {
    "email": r"\b(e-?mail|mail|contact|correo|courriel)\b",
    "ip": r"\b(ip|address|host|server|login)\b",
    "card": r"\b(card|visa|mastercard|credit|debit|tarjeta|carte|karte)\b",
    "phone": r"\b(phone|tel|telephone|call|mobile|fax|telefon)\b",
    "iban": r"\b(iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"\b(ssn|social|security)\b",
}
#: Added spans need this score; base spans always stay.
THRESHOLD = 0.5
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, also where body uses it inside of lambdas.

    A column that a lambda refers to may be computed anew for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it.

    Sums are appended within blocks and over blocks, as appending to one long array would
    copy it for each element.
    """

    def running(values: Column, start: Column) -> Column:
        return F.aggregate(
            values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)

    def within(blocks: Column, starts: Column) -> Column:
        return F.flatten(
            F.transform(blocks, lambda x, i: F.slice(running(x, F.get(starts, i)), F.lit(1), F.size(x)))
        )

    def over(own: Column) -> Column:
        last = F.floor((F.size(own) - 1) / _BLOCK).cast("int")
        numbers = F.sequence(F.lit(0), last)
        blocks = F.transform(numbers, lambda b: F.slice(own, b * _BLOCK + 1, _BLOCK))
        starts = lambda x: running(F.transform(x, total), F.lit(0))
        return _let(blocks, lambda x: _let(starts(x), lambda y: within(x, y)))

    return _let(lengths, over)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _mod_97(hit: Column) -> Column:
    """Remainder of an account number, its first four characters moved to the end."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    codes = F.transform(F.split(moved, ""), F.ascii)
    return F.aggregate(
        codes,
        F.lit(0),
        lambda acc, c: F.when(c >= 65, (acc * 100 + c - 55) % 97)
        .when(c >= 48, (acc * 10 + c - 48) % 97)
        .otherwise(acc),
    )


def _confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        n = F.length(_digits(hit))
        return (n >= 12) & (n <= 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return _mod_97(hit) == 1
    if kind == "ssn":
        return ~hit.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _maybe(kind: str, text: Column) -> Column:
    """A cheap test that texts without any match mostly fail."""
    if kind in ("email", "phone"):
        return F.instr(text, "@" if kind == "email" else "+") > 0
    return F.lit(True)


def _kind_spans(kind: str) -> Column:
    """Confirmed spans of a kind, from its columns of hits and of the gaps before them.

    Each step is linear in the number of hits: places are running sums, and what stands before
    a hit is put together from the pieces (gap and hit) before it, not cut from the text.
    """
    rank = KINDS.index(kind)
    hits, gaps = F.col(f"{kind}_hits"), F.col(f"{kind}_gaps")

    def weighed(hit: Column, start: Column, before: Column) -> Column:
        near = F.lower(F.substring(before, -CONTEXT_CHARS, CONTEXT_CHARS))
        bonus = SSN_BONUS if kind == "ssn" else CONTEXT_BONUS
        score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), bonus).otherwise(0.0)
        return F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            (start + F.length(hit)).alias("end"),
            F.round(score, 2).alias("score"),
        )

    def spans(pieces: Column, places: Column) -> Column:
        def span(hit: Column, i: Column) -> Column:
            gap = F.get(gaps, i)
            # A piece has a letter or more, so that these reach far enough back.
            some = F.slice(pieces, F.greatest(i - CONTEXT_CHARS, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT_CHARS)))
            before = F.when(F.length(gap) >= CONTEXT_CHARS, gap).otherwise(F.concat(F.array_join(some, ""), gap))
            whole = weighed(hit, F.get(places, i) + F.length(gap), before)
            return F.when(_confirmed(kind, hit), whole)

        return F.filter(F.transform(hits, span), lambda s: s.isNotNull())

    pieces = F.zip_with(gaps, hits, lambda g, h: F.concat(g, h))
    places = lambda x: _sums_before(F.transform(x, F.length))
    found = _let(pieces, lambda x: _let(places(x), lambda y: spans(x, y)))
    scored = F.when(F.size(hits) > 0, found)
    if kind not in BASE:
        scored = F.filter(scored, lambda s: s["score"] >= THRESHOLD)
    return F.coalesce(scored, F.array().cast(_SPANS))


#: Spans of a kind before they are put together.
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def with_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row of ``docs``, in one pass without a shuffle.

    spans is an array of (start, kind, end, score) by start, then kind as in KINDS; places
    are code points, the end exclusive. Matches of one kind do not overlap, leftmost first;
    a match that its check turns down is dropped, and nothing inside it is tried. email, ip,
    card and phone are always kept, iban (checked modulo 97) and ssn with the score that
    context words give. A null or empty text has no spans; equal rows have equal ones. An empty
    table gives an empty one; columns besides doc_id and text are not read. The time for a long
    text grows with its length and its number of matches.
    """
    empty = F.array().cast("array<string>")
    found = docs.select("doc_id", whole_text().alias("text"))
    for kind in KINDS:
        hits = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        maybe = F.when(_maybe(kind, F.col("text")), hits).otherwise(empty)
        found = found.withColumn(f"{kind}_hits", maybe)
    for kind in KINDS:
        own = F.col(f"{kind}_hits")
        gaps = F.slice(F.split("text", PATTERNS[kind], -1), F.lit(1), F.size(own))
        found = found.withColumn(f"{kind}_gaps", F.when(F.size(own) > 0, gaps).otherwise(empty))
    columns = [_kind_spans(kind) for kind in KINDS]
    spans = F.transform(
        F.array_sort(F.concat(*columns)),
        lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind", "end", "score"))),
    )
    return found.select("doc_id", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(one, ",")


def _kind_sql(kind: str, pattern: str, check: str, score: str = "1.0") -> str:
    return f"""
    SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind)} AS rank, start, start + length(hit) AS stop FROM (
        SELECT doc_id, t, unnest(hits) AS hit, unnest(list_transform(range(1, len(hits) + 1), lambda i: CAST(
            list_sum(list_transform(gaps[1:i], lambda g: length(g)))
            + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT))) AS start
        FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS hits, regexp_split_to_array(t, '{pattern}') AS gaps
              FROM texts)
    ) WHERE {check} AND {score} >= {THRESHOLD}"""


_DIGITS_SQL = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN_SQL = f"""list_sum(list_transform(range(1, length({_DIGITS_SQL}) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS_SQL}), i, 1) AS INT)
    ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(reverse({_DIGITS_SQL}), i, 1) AS INT) + 1] END)) % 10 = 0"""
_IP_SQL = "list_max(list_transform(string_split(hit, '.'), lambda p: CAST(p AS HUGEINT))) <= 255"
_MOVED_SQL = "substr(replace(hit, ' ', ''), 5) || substr(replace(hit, ' ', ''), 1, 4)"
_IBAN_SQL = f"""list_reduce(list_prepend(0, list_transform(string_split({_MOVED_SQL}, ''), lambda c: ascii(c))),
    lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1"""
_NEAR_SQL = f"lower(substr(t, greatest(start - {CONTEXT_CHARS}, 0) + 1, least(start, {CONTEXT_CHARS})))"
_PARTS_SQL = [
    _kind_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    _kind_sql("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _IP_SQL),
    _kind_sql("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS_SQL}) BETWEEN 12 AND 19 AND {_LUHN_SQL}"),
    _kind_sql("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS_SQL}) BETWEEN 9 AND 15"),
    _kind_sql("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", _IBAN_SQL),
    _kind_sql(
        "ssn",
        r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "NOT regexp_matches(hit, '^(?:000|666|9)|-00-|-0000$')",
        rf"(CASE WHEN regexp_matches({_NEAR_SQL}, '{CONTEXT['ssn']}') THEN {SCORES['ssn'] + SSN_BONUS} ELSE {SCORES['ssn']} END)",
    ),
]
PII_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_PARTS_SQL)}),
joined AS (
    SELECT doc_id,
        {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
    FROM spans GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN joined USING (doc_id)
"""
