"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Only DataFrame functions are used. A pattern's matches and the text between them, both in
order, give the position of each match; positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import fresh


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``pattern`` must match no empty text. It is written so that a failed attempt is not tried
    again inside the same run of characters, which keeps long texts linear. ``valid``: SQL over
    ``m``, the match. ``score`` is what a valid match has by itself; one of ``words`` within
    CONTEXT characters before it adds NEAR, one of ``against`` takes AWAY. Spans of THRESHOLD or
    more are reported with their score; those of kinds without words have a fixed one.
    """

    name: str
    pattern: str
    valid: str
    score: float = 1.0
    words: str | None = None
    needs: str | None = None
    against: str | None = None


THRESHOLD = 0.5
CONTEXT = 40
NEAR = 0.4
AWAY = 0.4

_DIGITS = "regexp_replace(m, '[^0-9]+', '')"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Sum of Luhn: digits from the right, every second one doubled, nines taken off.
_LUHN = (
    f"transform(array(reverse({_DIGITS})), d -> aggregate(sequence(1, length(d)), 0, (a, i) -> a + "
    "if(i % 2 = 1, int(substr(d, i, 1)), int(substr('0246813579', int(substr(d, i, 1)) + 1, 1)))))[0] % 10 = 0"
)
#: Remainder by 97 of the number that an account number spells, country and check digits moved to the end.
_MOD97 = (
    "transform(array(regexp_replace(m, ' ', '')), d -> aggregate(split(substr(d, 5) || substr(d, 1, 4), ''), 0, "
    "(a, c) -> if(c = '', a, if(c < 'A', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97))))[0] = 1"
)

BASE = [
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", needs="@",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", rf"m rlike '^{_OCTET}(?:[.]{_OCTET}){{3}}$'"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15", needs="+"),
]
#: Length of an account number by country: those of the registry, then those in use without being in it.
_LENGTHS = (
    "NO15 BE16 DK18 FI18 FK18 FO18 GL18 NL18 SD18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 MN20 XK20 CH21 HR21 LI21 LV21 BG22 BH22 CR22 "
    "DE22 GB22 GE22 IE22 ME22 RS22 VA22 AE23 GI23 IL23 IQ23 OM23 SO23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 LY25 "
    "PT25 ST25 IS26 TR26 BI27 DJ27 FR27 GR27 IT27 MC27 MR27 SM27 AL28 AZ28 BY28 CY28 DO28 GT28 HN28 HU28 LB28 NI28 PL28 SV28 BR29 EG29 PS29 "
    "QA29 UA29 JO30 KW30 MU30 YE30 MT31 SC31 LC32 RU33 "
    "AO25 CV25 GW25 MZ25 DZ26 IR26 CF27 CG27 CM27 GA27 GQ27 KM27 MG27 TD27 BF28 BJ28 CI28 MA28 ML28 NE28 SN28 TG28"
).split()
#: A number ends where its country says, whatever capitals or digits follow after a blank.
_IBAN = "|".join(
    rf"(?:{'|'.join(x[:2] for x in _LENGTHS if x[2:] == n)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{int(n) - 4}}}" for n in sorted({x[2:] for x in _LENGTHS})
)
#: Kinds beyond the base: account numbers by mod-97; shorter card numbers and plain phone numbers only near their words.
MORE = [
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])", _MOD97, 0.6, "iban|account|konto|cuenta|compte",
         against="example|sample|dummy|beispiel|ejemplo|exemple"),
    Kind(
        "short_card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", f"length({_DIGITS}) BETWEEN 13 AND 15 AND {_LUHN}", 0.3,
        "card|karte|carte|tarjeta|visa|amex|credit", against="example|sample|dummy|invoice|order|serial|isbn|version",
    ),
    Kind(
        "local_phone", r"(?<![0-9+.])[0-9]{3}[-.\x20][0-9]{3}[-.\x20][0-9]{4}(?![0-9])", "true", 0.3,
        "phone|call|tel|mobile|fax|telefon|telefono", against="example|sample|dummy|invoice|order|serial|isbn|version",
    ),
]


def _spans(kind: Kind, text: str) -> Column:
    """Array of (kind, start, end) of the kind's reported matches in a text, in order."""
    pattern = kind.pattern.replace("\\", "\\\\")
    gaps, found = f"split({text}, '{pattern}', -1)", f"regexp_extract_all({text}, '{pattern}', 0)"
    # start of match k: all gaps up to k and all matches before it
    walk = (
        "aggregate(zip_with(slice(g, 1, size(f)), f, (x, m) -> struct(x AS x, m AS m)), "
        "struct(0 AS at, cast(array() AS array<struct<m: string, s: int, e: int>>) AS out), "
        "(a, p) -> struct(a.at + char_length(p.x) + char_length(p.m) AS at, "
        "if({good}, a.out || array(struct(p.m AS m, a.at + char_length(p.x) AS s, a.at + char_length(p.x) + char_length(p.m) AS e)), a.out) AS out), "
        "a -> a.out)"
    )
    good = f"transform(array(p.m), m -> {kind.valid})[0]"
    spans = f"transform(array({found}), f -> if(size(f) = 0, null, transform(array({gaps}), g -> {walk.replace('{good}', good)})[0]))[0]"
    score = "1.0D"
    if kind.words or kind.against:
        before = f"lower(substr({text}, greatest(s.s - {CONTEXT} + 1, 1), least({CONTEXT}, s.s)))"
        parts = [f"if({before} rlike '{words}', {change}D, 0D)" for words, change in ((kind.words, NEAR), (kind.against, -AWAY)) if words]
        score = f"round(least(1D, greatest(0D, {kind.score}D + {' + '.join(parts)})), 3)"
    spans = f"filter(transform({spans}, s -> struct(s.s AS s, s.e AS e, {score} AS score)), s -> s.score >= {THRESHOLD}D)"
    if kind.needs:
        spans = f"if(instr({text}, '{kind.needs}') = 0, null, {spans})"
    none = "cast(array() AS array<struct<s: int, e: int, score: double>>)"
    return F.transform(
        F.expr(f"coalesce({spans}, {none})"), lambda s: F.struct(F.lit(kind.name).alias("kind"), s["s"].alias("start"), s["e"].alias("end"), s["score"].alias("score"))
    )


def find(docs: DataFrame, kinds: list[Kind] = BASE + MORE) -> DataFrame:
    """``docs`` with one array column per kind, ``pii_<kind>``: structs of kind, start, end and score.

    Matches of a kind are leftmost and do not overlap; a match that fails its check is dropped
    and not tried again from another place. Kinds are independent, so spans of different kinds
    may overlap. A null or empty text has no spans, very long texts are searched whole. All rows and other columns stay; columns
    named ``pii_<kind>`` are replaced. An empty table gives no rows.
    """
    text = fresh("_text", docs)
    rows = docs.withColumn(text, F.coalesce("text", F.lit("")))
    return rows.withColumns({f"pii_{k.name}": _spans(k, text) for k in kinds}).drop(text)


def mask(docs: DataFrame, kinds: list[Kind] = BASE + MORE) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets.

    Spans are put in order of their start, longer first; one that begins inside an earlier
    one is swallowed by it up to the farther end. A null text stays null; other columns stay, but
    for those named ``pii_<kind>``.
    """
    found = find(docs, kinds)
    names = [f"pii_{k.name}" for k in kinds]
    ordered = F.array_sort(F.flatten(F.array(*names)), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]))
    spans = fresh("_spans", found)
    rows = found.withColumn(spans, ordered)
    masked = F.expr(
        f"aggregate({spans}, struct('' AS done, 0 AS at), (a, s) -> struct("
        "if(s.start < a.at, a.done, concat(a.done, substr(text, a.at + 1, s.start - a.at), '<', s.kind, '>')) AS done, "
        "greatest(a.at, s.end) AS at), a -> concat(a.done, substr(text, a.at + 1)))"
    )
    return rows.withColumn("text", F.when(F.col("text").isNotNull(), masked)).drop(spans, *names)


def joined(kinds: list[Kind]) -> Column:
    """All spans of these kinds as kind:start:end, comma-joined, by kind as listed, then start."""
    spans = F.flatten(F.array(*[f"pii_{k.name}" for k in kinds]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sql_spans(kind: str, pattern: str, valid: str, near: str = "true") -> str:
    """DuckDB list of kind:start:end; the pattern is written for a regex engine without look-around."""
    return (
        f"SELECT doc_id, {len(kind)} AS w, '{kind}' AS kind, s, s + length(m) AS e, row_number() OVER () AS r FROM ("
        f"SELECT doc_id, text, m, sum(length(g)) OVER (PARTITION BY doc_id ORDER BY k) + sum(length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m) AS s FROM ("
        f"SELECT doc_id, text, unnest(f) AS m, unnest(g[1:len(f)]) AS g, unnest(range(len(f))) AS k FROM ("
        f"SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS f, string_split_regex(text, '{pattern}') AS g FROM d))) WHERE {valid} AND {near}"
    )


def _sql_luhn(digits: str) -> str:
    return (
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({digits}), i, 1) AS INT) "
        f"ELSE CAST(substr('0246813579', CAST(substr(reverse({digits}), i, 1) AS INT) + 1, 1) AS INT) END)) % 10 = 0"
    )


_D = "regexp_replace(m, '[^0-9]+', '', 'g')"
#: DuckDB form of the base kinds.
_BASE_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_full_match(m, '{_OCTET}(?:[.]{_OCTET}){{3}}')"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_D}) BETWEEN 16 AND 19 AND {_sql_luhn(_D)}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_D}) BETWEEN 8 AND 15"),
}


def oracle() -> str:
    """DuckDB SQL for counts and digest of the base spans."""
    parts = " UNION ALL ".join(f"SELECT {n} AS place, * FROM ({_sql_spans(k, p, v)})" for n, (k, (p, v)) in enumerate(_BASE_SQL.items()))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _BASE_SQL)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), spans AS ({parts}), "
        f"found AS (SELECT doc_id, {counts}, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY place, s) AS joined FROM spans GROUP BY doc_id) "
        f"SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _BASE_SQL)}, sha256(coalesce(joined, '')) AS base_sha256 FROM d LEFT JOIN found USING (doc_id)"
    )
