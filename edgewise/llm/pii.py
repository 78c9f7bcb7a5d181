"""Personal data in whole texts, found in DataFrame operations only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, the
ranges of address parts, the digits of phone numbers), and words shortly before or after a span move its
score. Four base kinds (email, ip, card, phone) are kept whenever they are valid; the further kinds
(iban, ssn, secret) need a score of ``threshold``.

Positions are code points, end exclusive. They come from the lengths of the matches and of the
gaps between them, so each pattern passes over a text once or twice and no pattern backtracks over
more than one run of characters.

Edge cases: a null text is treated as empty and has no spans; an empty table gives an empty result;
very long runs without a match take linear time; repeated rows are judged alike; columns of the
input named as those that ``find_pii`` adds are replaced in its output, all others stay, whatever
their names; ``redact`` changes no column but the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """``pattern`` finds what the leftmost non-overlapping search of ``base`` finds, in linear time."""

    name: str
    pattern: str
    hint: str
    context: str
    score: float
    base: bool = True


#: The patterns of the kinds, in the order of the output.
#: A match may begin at the start of a run or right after the match before (\G), never inside a run.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"(?i)\b(e-?mail|contact|write|mailto)\b", 0.9),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"(?i)\b(ip|host|server|address)\b", 0.7),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", "", r"(?i)\b(card|visa|credit|payment)\b", 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", r"(?i)\b(tel|phone|call|mobile|fax)\b", 0.7),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}(?![A-Za-z0-9])){2,7}+(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "", r"(?i)\b(iban|bank|account|konto|compte)\b", 0.6, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", r"(?i)\b(ssn|social|security)\b", 0.3, False),
    Kind("secret", r"(?i)\b(?:password|passwd|token|secret|api_?key)\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9_./+-]{8,}+", "", r"(?i)\b(login|user|key|auth)\b", 0.6, False),
)
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of ``text`` pass the Luhn check."""
    numbers = F.reverse(F.split(_digits(text), ""))
    double = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    weighed = F.transform(numbers, lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether ``text``, its spaces dropped, passes the ISO 13616 check."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    letter = lambda c: F.ascii(c) - 55
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).when(c.rlike("^[A-Z]$"), (a * 100 + letter(c)) % 97).otherwise(a),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


SPAN = "array<struct<kind:string,start:int,end:int,score:double,match:string>>"


def _spans(kind: Kind, text: Column, found: Column, threshold: float) -> Column:
    """Valid spans of one kind, from its matches: positions are summed over matches and gaps."""
    gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("done"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(a["done"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("done"))

    placed = F.filter(F.aggregate(pairs, start, step, lambda a: a["done"]), lambda s: _valid(kind.name, s["m"]))

    def scored(s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        before, after = text.substr(begin + 1, s["start"] - begin), text.substr(s["end"] + 1, F.lit(CONTEXT_CHARS))
        score = F.lit(kind.score) + F.when(before.rlike(kind.context) | after.rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"), s["m"].alias("match"))

    out = F.transform(placed, scored)
    out = out if kind.base else F.filter(out, lambda s: s["score"] >= threshold)
    return F.when(F.size(found) > 0, out).otherwise(F.array().cast(SPAN))


def _free(docs: DataFrame, stem: str) -> str:
    """A prefix that no column of ``docs`` begins with."""
    while any(c.lower().startswith(stem) for c in docs.columns):
        stem = "_" + stem
    return stem


def _with_spans(docs: DataFrame, text_col: str, threshold: float) -> tuple[DataFrame, str]:
    """``docs`` with a column of spans for each kind, and the prefix of these columns' names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    nothing = F.array().cast("array<string>")
    found, spans = _free(docs, "_found_"), _free(docs, "_spans_")
    matches = {
        found + k.name: F.when(F.contains(text, F.lit(k.hint)), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(nothing)
        if k.hint
        else F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
        for k in KINDS
    }
    placed = {spans + k.name: _spans(k, text, F.col(found + k.name), threshold) for k in KINDS}
    return docs.withColumns(matches).withColumns(placed).drop(*matches), spans


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with a column ``spans_<kind>`` for each kind: kind, start, end, score and match of each span."""
    out, spans = _with_spans(docs, text_col, threshold)
    added = {f"spans_{k.name}": F.col(spans + k.name) for k in KINDS}
    return out.select(*[c for c in docs.columns if c.lower() not in added], *[v.alias(k) for k, v in added.items()])


def span_text(kinds: list[str], prefix: str = "spans_") -> Column:
    """kind:start:end of all spans of ``kinds``, comma-joined."""
    every = F.concat(*[F.col(prefix + k) for k in kinds])
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; of overlapping spans the first, then longer, counts."""
    found, spans = _with_spans(docs, text_col, threshold)
    every = F.concat(*[F.col(spans + k.name) for k in KINDS])
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))
    text = F.col(text_col)

    def step(a: Column, s: Column) -> Column:
        free = s["start"] >= a["at"]
        piece = F.concat(text.substr(a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(free, F.struct((-s["minus_end"]).alias("at"), F.concat(a["out"], piece).alias("out"))).otherwise(a)

    clean = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))),
    )
    return found.withColumn(text_col, F.when(F.size(every) > 0, clean).otherwise(text)).select(*docs.columns)


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = [k.name for k in KINDS if k.base]
    return find_pii(docs).select(
        "doc_id",
        *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in base],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text([k.name for k in KINDS]).alias("spans"),
    )


#: The patterns as SQL can state them: its engine has no look-around, so runs are matched whole where that says the same (ssn), and a word boundary
#: ends an iban. Of the further kinds only ssn depends on words nearby.
OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
kinds(k, kind, pattern) AS (VALUES
  (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+'),
  (3, 'card', '[0-9](?:[\\x20-]?[0-9])+'), (4, 'phone', '\\+[0-9][\\x20().0-9-]+[0-9]'),
  (5, 'iban', '\\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\\x20[A-Z0-9]{4}\\b){2,7}(?:\\x20[A-Z0-9]{1,3})?)\\b'), (6, 'ssn', '[0-9-]+'),
  (7, 'secret', '(?i)\\b(?:password|passwd|token|secret|api_?key)\\s{0,3}[:=]\\s{0,3}["'']?[A-Za-z0-9_./+-]{8,}')),
lists AS (SELECT doc_id, text, k, kind, regexp_extract_all(text, pattern) AS m, string_split_regex(text, pattern) AS gaps FROM d, kinds WHERE regexp_matches(text, pattern)),
each AS (SELECT doc_id, text, k, kind, unnest(m) AS m, unnest(gaps[1 : len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM lists),
placed AS (SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) - length(m))::BIGINT AS s FROM each),
digits AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS plain FROM placed),
spans AS (
  SELECT doc_id, k, kind, s, s + length(m) AS e FROM digits WHERE CASE kind
    WHEN 'ip' THEN list_bool_and([ltrim(x, '0') = '' OR (length(ltrim(x, '0')) <= 3 AND ltrim(x, '0')::INT <= 255) FOR x IN string_split(m, '.')])
    WHEN 'card' THEN length(d) BETWEEN 16 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN substr(reverse(d), i, 1)::INT
      ELSE (substr(reverse(d), i, 1)::INT * 2) % 10 + (substr(reverse(d), i, 1)::INT * 2) // 10 END FOR i IN range(1, length(d) + 1)]) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 8 AND 15
    WHEN 'iban' THEN length(plain) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, [CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END
      FOR c IN string_split(substr(plain, 5) || substr(plain, 1, 4), '')]), lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
    WHEN 'ssn' THEN regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')
      AND regexp_matches(substr(text, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)) || ' | ' || substr(text, s + length(m) + 1, 40), '(?i)\\b(ssn|social|security)\\b')
    ELSE TRUE END),
joined AS (
  SELECT doc_id, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card, count(*) FILTER (k = 4) AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k <= 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (doc_id)
"""

QUERIES = {"op5_pii": op5_query}
SQL = {"op5_pii": OP5_SQL}
