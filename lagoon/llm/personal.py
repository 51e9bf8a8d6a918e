"""Personal data in texts, by column expressions alone.

Regular expressions propose spans; a checksum or a rule confirms them (Luhn for
cards, mod 97 for account numbers, ranges and digit counts for the others); words
next to a span move its score. Kinds that have no checksum are kept for their
score, the base kinds whatever it is.

A pattern's matches come from one function and the gaps between them from another,
so that places are running sums of lengths. Sums are made in blocks of about the
square root of their number, as a fold that grows one array copies it each time.
Patterns start only where no longer match could have started and never give back
what they took, so a search is linear in the text whatever it holds.

Defined cases: a null text is empty, and an empty text has no spans and the digest
of the empty string; a null id is kept; rows are independent, so repeated rows
repeat their spans; an empty table gives no rows; further columns are ignored,
whatever their names; texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points on each side of a span that are searched for words about it.
NEAR = 32


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _any(match: Column) -> Column:
    return F.lit(True)


def _parts_fit(match: Column) -> Column:
    """No part of an address is over 255; leading zeros don't count."""
    bare = F.transform(F.split(match, "[.]"), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _luhn(match: Column) -> Column:
    d = _digits(match)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


def _dialled(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def _apart(before: Column, after: Column) -> Column:
    """Neither neighbour is a letter or digit of ASCII."""
    return ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")


def _mod97(match: Column) -> Column:
    """Country and check digits go to the end, letters count from 10, and the number leaves 1."""
    bare = F.regexp_replace(match, " ", "")
    moved = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")
    value = lambda c: F.instr(F.lit("0123456789" + _UPPER), c) - 1
    rest = F.aggregate(moved, F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(F.pmod(acc * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97))))
    return F.length(bare).between(15, 34) & (rest == 1)


def _issued(match: Column) -> Column:
    """Areas 000, 666 and from 900 on, group 00 and serial 0000 are never given out."""
    return ~match.rlike("^(000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # what a text must hold for the pattern to match at all
    confirmed: Callable[[Column], Column]
    score: int
    words: str  # next to the span they raise the score
    doubts: str = ""  # and these lower it
    base: bool = True
    sql: str = ""  # the pattern as it is defined, where the one above says the same in another way


RAISE, LOWERED, KEPT = 30, 40, 50

#: In the order of the digest. The base patterns' languages are fixed by what counts as a match.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", _any, 90, "mail|email|contact|write|correo|courriel|kontakt", "example", sql=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", _parts_fit, 60, "ip|host|server|address|from|login|adresse|servidor", "version|release|section|chapter", sql=r"[0-9]+(?:\.[0-9]+){3}"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "", _luhn, 70, "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta", "order|invoice|tracking|serial", sql=r"[0-9](?:[ -]?[0-9])+"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", _dialled, 60, "phone|tel|call|mobile|fax|telefon|telephone|telefono"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", "", _mod97, 80, "iban|account|bank|konto|compte|cuenta", base=False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", _issued, 30, "ssn|social|security", "order|part|model", base=False),
)


def blocked(sizes: Column) -> tuple[Column, Column]:
    """Sums of all that stands before each block of elements, and the elements in a block."""
    n = F.size(sizes)
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("int")
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / step).cast("int"))), lambda b: add(F.slice(sizes, b * step + 1, step)))
    before = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return before, step


def _near(words: str, context: Column) -> Column:
    return context.rlike(f"(^|[^a-z])({words})([^a-z]|$)")


def _proposed(kind: Kind, text: Column) -> tuple[Column, Column]:
    """Matches of a kind, and the gaps before, between and after them."""
    some = F.contains(text, F.lit(kind.hint)) if kind.hint else text.rlike("[0-9]")
    none = F.array().cast("array<string>")
    return F.when(some, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(none), F.when(some, F.split(text, kind.pattern, -1)).otherwise(none)


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each row: an array of (start, place of the kind, kind, end, score) in order; places are code points, the end exclusive, scores 0 to 100."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", *(c.alias(f"{k.name}_{n}") for k in kinds for c, n in zip(_proposed(k, F.col("text")), ("match", "gap"), strict=True)))
    sizes = lambda k: F.transform(F.col(f"{k.name}_match"), lambda m, i: F.length(F.col(f"{k.name}_gap")[i]) + F.length(m))
    rows = rows.select("*", *(sizes(k).alias(f"{k.name}_size") for k in kinds))
    rows = rows.select("*", *(c.alias(f"{k.name}_{n}") for k in kinds for c, n in zip(blocked(F.col(f"{k.name}_size")), ("sums", "step"), strict=True)))

    def spans(place: int, k: Kind) -> Column:
        match, gap, size, sums, step = (F.col(f"{k.name}_{n}") for n in ("match", "gap", "size", "sums", "step"))
        lower = lambda c: F.translate(c, _UPPER, _LOWER)

        def span(m: Column, i: Column) -> Column:
            block = F.floor(i / step).cast("int")
            start = sums[block] + F.aggregate(F.slice(size, block * step + 1, i - block * step), F.lit(0), lambda a, x: a + x) + F.length(gap[i])
            before, after = F.substring(gap[i], -NEAR, NEAR), F.substring(gap[i + 1], 1, NEAR)
            context = lower(F.concat(before, F.lit("\n"), after))
            ok = k.confirmed(m) if k.base else k.confirmed(m) & _apart(before, after)
            score = F.lit(k.score) + F.when(_near(k.words, context), RAISE).otherwise(0)
            if k.doubts:
                score = score - F.when(_near(k.doubts, context), LOWERED).otherwise(0)
            return F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(k.name).alias("kind"), (start + F.length(m)).alias("end"), F.least(F.lit(100), score).alias("score"), ok.alias("ok"))

        made = F.filter(F.transform(match, span), lambda s: s["ok"])
        made = made if k.base else F.filter(made, lambda s: s["score"] >= KEPT)
        return F.transform(made, lambda s: s.dropFields("ok"))

    every = F.array_sort(F.concat(*(spans(p, k) for p, k in enumerate(kinds))))
    return rows.select(F.col("id").alias(id_col), every.alias("spans"))


def joined(spans: Column, fields: tuple[str, ...] = ("kind", "start", "end")) -> Column:
    """Spans as text, such as email:3:20,card:40:56."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *(s[f].cast("string") for f in fields))), ",")


def _kind_sql(place: int, k: Kind) -> str:
    confirmed = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR (len(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0",
        "card": "len(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda j: CASE WHEN (len(d) - j) % 2 = 0 THEN d[j]::INT ELSE (2 * d[j]::INT) // 10 + (2 * d[j]::INT) % 10 END)) % 10 = 0",
        "phone": "len(d) BETWEEN 9 AND 15",
        "iban": f"len(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(replace(m, ' ', '')[5:] || m[:4], ''), lambda c: strpos('0123456789{_UPPER}', c) - 1), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0) = 1",
        "ssn": "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
    }[k.name]
    near = lambda words: f"regexp_matches(translate(g || chr(10) || h, '{_UPPER}', '{_LOWER}'), '(^|[^a-z])({words})([^a-z]|$)')"
    score = f"{k.score} + CASE WHEN {near(k.words)} THEN {RAISE} ELSE 0 END" + (f" - CASE WHEN {near(k.doubts)} THEN {LOWERED} ELSE 0 END" if k.doubts else "")
    kept = "" if k.base else f" AND NOT regexp_matches(g, '[A-Za-z0-9]$') AND NOT regexp_matches(h, '^[A-Za-z0-9]') AND {score} >= {KEPT}"
    pattern = k.sql or k.pattern
    return f"""SELECT r, {place} AS place, '{k.name}' AS kind, s, s + len(m) AS e, least(100, {score}) AS score FROM (
  SELECT r, m, right(g, {NEAR}) AS g, left(h, {NEAR}) AS h, regexp_replace(m, '[^0-9]', '', 'g') AS d, coalesce(sum(len(g) + len(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len(g) AS s FROM (
    SELECT r, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, unnest(gs[2:]) AS h FROM (
      SELECT r, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM t))) WHERE {confirmed}{kept}"""


OP13_SQL = "WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), s AS (" + " UNION ALL ".join(_kind_sql(p, k) for p, k in enumerate(KINDS)) + f""")
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in KINDS if k.base)},
  sha256(coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, place) FILTER (WHERE place < {sum(k.base for k in KINDS)}), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, place), '') AS spans,
  coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) || ':' || score, ',' ORDER BY s, place), '') AS scored
FROM t LEFT JOIN s USING (r) GROUP BY r"""


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [k.name for k in KINDS if k.base]
    of = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    return found.select(
        "doc_id", *(of(name).alias(f"n_{name}") for name in base),
        F.sha2(joined(F.filter("spans", lambda s: s["place"] < len(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), joined(F.col("spans"), ("kind", "start", "end", "score")).alias("scored"),
    )
