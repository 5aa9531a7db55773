"""Personal data: expressions propose spans, checksums confirm, context adjusts.

Each kind has an expression, a check and a starting score.  ``split`` by the
expression gives the stretches between matches, so places follow from
lengths; the ``CONTEXT`` characters on either side are its context, other matches included.
An iban's expression finds where it starts; its end is the one, of those at the border of a token, that
its country's length names, else the last one whose checksum holds.  A confirmed checksum
(Luhn, mod 97) raises a span's score, words that speak of such a number
nearby raise it, words that speak of something else lower it.

The four base kinds are returned whatever their score when their check
holds; the added kinds (iban; id, a number named by its context) need a score of at
least ``THRESHOLD``.  Places are code points, the end is exclusive.

Defined results: a null text counts as empty (no spans); repeated rows and
ids keep one row each; other columns are not read; an empty table gives an empty
result.  Long runs of one character cost linear time: expressions are
anchored to the start of a run, and repetitions give nothing back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 48
THRESHOLD = 0.6
#: Change of score by the context or a checksum.
STEP = 0.3

_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    #: SQL over the match ``m`` that must hold.
    valid: str
    #: SQL over ``m``: a checksum that raises the score.
    checksum: str
    nearby: str
    against: str
    base: bool = True


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
# sum of the digits with every second one from the right doubled
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a +
    CASE WHEN i % 2 = 1 THEN int(substring({_DIGITS}, -i, 1))
    ELSE 2 * int(substring({_DIGITS}, -i, 1)) - IF(int(substring({_DIGITS}, -i, 1)) > 4, 9, 0) END) % 10 = 0"""
_PLAIN = "replace(m, ' ', '')"
# letters count from 10; the first four characters go to the end
def _mod97(plain: str) -> str:
    return f"""aggregate(split(concat(substring({plain}, 5), substring({plain}, 1, 4)), ''), 0, (a, c) ->
    CASE WHEN c = '' THEN a WHEN c BETWEEN '0' AND '9' THEN (a * 10 + int(c)) % 97
    ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"""


#: Lengths of the countries' ibans, without spaces.
IBAN_LENGTHS = dict(x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 "
    "FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LI:21 LT:20 "
    "LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SE:24 SI:19 "
    "SK:24 SM:27 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20").split())
#: Characters after an iban's start that it can reach, spaces and the next one included.
_REACH = 69

KINDS = (
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "true", "false",
         "mail|contact|write|reach", "example"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6,
         "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND int(right(concat('000', p), 3)) <= 255)", "false",
         "address|host|server|login|ip", "version|release|chapter|section"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.5, f"length({_DIGITS}) BETWEEN 12 AND 19 AND ({_LUHN})", "true",
         "card|visa|credit|debit|payment|pay", "order|isbn|serial|tracking"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, f"length({_DIGITS}) BETWEEN 9 AND 15", "false",
         "phone|call|tel|mobile|fax", "version|score"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})", 0.35, "true", "true",
         "iban|account|bank|transfer", "serial|part", base=False),
    Kind("id", r"(?<![0-9A-Za-z.,+-])[0-9]{3}-?[0-9]{2}-?[0-9]{4}(?![0-9A-Za-z-])", 0.3, "true", "false",
         r"\b(?:ssn|passport|social security|tax id|insurance number|licen[cs]e no)\b", r"\b(?:order|isbn|version|part)\b", base=False),
)


def _needs(kind: Kind, text: str) -> str:
    """A cheap test without which the expression can't match."""
    return {"email": f"contains({text}, '@')", "phone": f"contains({text}, '+')"}.get(kind.name, f"{text} RLIKE '[0-9]{{2}}|[0-9][ .-][0-9]'")


def _spans(kind: Kind, order: int, text: str) -> Column:
    """array<struct<start, ord, stop, kind, score, text>> of one kind."""
    quoted = kind.pattern.replace("\\", "\\\\").replace("'", "\\'")
    around = lambda words: "false" if not words else f"""(lower({{before}}) RLIKE '{words.replace(chr(92), chr(92) * 2)}'
        OR lower({{after}}) RLIKE '{words.replace(chr(92), chr(92) * 2)}')"""  # noqa: E731
    score = f"""round({kind.score}D + IF({kind.checksum}, {STEP}D, 0D) + IF({around(kind.nearby)}, {STEP}D, 0D)
        - IF({around(kind.against)}, {STEP}D, 0D), 2)"""
    accept = "true" if kind.base else f"{score} >= {THRESHOLD}D"
    # what follows match i: a match and the stretch before it have three characters at least
    ahead = lambda n: f"""left(array_join(transform(sequence(x.i + 1, least(x.i + {-(-n // 3) + 1}, size(ps) - 1)),
        j -> concat(left(ps[j], {n}), left(coalesce(get(ms, j), ''), {n}))), ''), {n})"""  # noqa: E731
    fill = lambda sql, after: _named(sql.replace("{before}", "right(x.head, " + str(CONTEXT) + ")").replace("{after}", after))
    if kind.name == "iban":
        plain = "replace(left(w.win, n), ' ', '')"
        ends = f"""filter(sequence(15, {_REACH}), n -> n <= w.most AND substring(w.win, n, 1) <> ' '
            AND NOT substring(w.win, n + 1, 1) RLIKE '[A-Za-z0-9]' AND length({plain}) BETWEEN 15 AND 34 AND ({_mod97(plain)}))"""
        lengths = "map(" + ", ".join(f"'{c}', {n}" for c, n in IBAN_LENGTHS.items()) + ")"
        chosen = f"""coalesce(get(filter(e.ends, n -> length(replace(left(w.win, n), ' ', '')) = {lengths}[left(w.win, 2)]), 0),
            get(e.ends, size(e.ends) - 1))"""
        body = r"^[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}+"
        reach = f"concat(x.m, {ahead(_REACH + CONTEXT)})"
        length = f"""transform(transform(array(struct({reach} AS win)), v -> struct(v.win AS win,
            length(regexp_extract(v.win, '{body}', 0)) AS most)), w -> struct(w.win AS win,
            transform(array(struct({ends} AS ends)), e -> {chosen})[0] AS n))"""
        after = f"substring(l.win, l.n + 1, {CONTEXT})"
        made = f"""transform(filter({length}, l -> l.n IS NOT NULL AND x.start >= a.free AND ({fill(accept, after)})),
            l -> struct(x.start AS start, {order} AS ord, int(x.start + l.n) AS stop, '{kind.name}' AS kind,
                least(1D, greatest(0D, {fill(score, after)})) AS score, left(l.win, l.n) AS text))"""
    else:
        after = ahead(CONTEXT)
        made = f"""transform(filter(array(x), x -> {fill(f"({kind.valid}) AND ({accept})", after)}), x -> struct(
            x.start AS start, {order} AS ord, x.start + length(x.m) AS stop, '{kind.name}' AS kind,
            least(1D, greatest(0D, {fill(score, after)})) AS score, x.m AS text))"""
    # lengths of stretches and matches, then their running sum
    body = f"""aggregate(sequence(0, size(ms) - 1), struct(0 AS at, 0 AS free, '' AS tail,
            cast(array() AS array<struct<start:int,ord:int,stop:int,kind:string,score:double,text:string>>) AS found),
        (a, i) -> transform(transform(array(struct(i AS i, ms[i] AS m, a.at + length(ps[i]) AS start, concat(a.tail, right(ps[i], {CONTEXT})) AS head)),
            x -> struct(x AS x, {made} AS made)), y -> struct(
                y.x.start + length(y.x.m) AS at, coalesce(y.made[0].stop, a.free) AS free,
                right(concat(y.x.head, right(y.x.m, {CONTEXT})), {CONTEXT}) AS tail, concat(a.found, y.made) AS found))[0], a -> a.found)"""
    body = body.replace("y.made[0]", "get(y.made, 0)")
    none = "cast(array() AS array<struct<start:int,ord:int,stop:int,kind:string,score:double,text:string>>)"
    # matches and stretches are found once: a lambda over a one-element array names them
    return F.expr(f"""CASE WHEN {_needs(kind, text)} THEN
        flatten(transform(filter(array(struct(regexp_extract_all({text}, '{quoted}', 0) AS ms)), y -> size(y.ms) > 0),
        y -> transform(array(struct(y.ms AS ms, split({text}, '{quoted}', -1) AS ps)), z -> {_of('z', body)})[0])) ELSE {none} END""")


def _named(sql: str) -> str:
    import re

    return re.sub(r"(?<![.'\w])m\b(?!\s*\()", "x.m", sql)


def _of(name: str, sql: str) -> str:
    import re

    return re.sub(r"(?<!\.)\b(ms|ps)\b(?=[\[),])", rf"{name}.\1", sql)


def find_spans(df: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with an array of spans (start, ord, stop, kind, score, text) by start, then kind."""
    text = f"coalesce(`{text_col}`, '')"
    found = F.array_sort(F.concat(*[_spans(k, i, text) for i, k in enumerate(KINDS)]))
    return df.withColumn(out, found)


def redact(df: DataFrame, text_col: str = "text", mask: str = "<{}>", out: str = "redacted") -> DataFrame:
    """``df`` with a copy of the text in which spans are replaced by their kind; of
    overlapping spans the one that starts first is replaced, the others lie in it or are cut short."""
    text = f"coalesce(`{text_col}`, '')"
    left, _, right = mask.partition("{}")
    built = F.expr(f"""aggregate(__spans, struct(0 AS at, cast(array() AS array<string>) AS parts), (a, s) ->
        struct(greatest(a.at, s.stop) AS at, concat(a.parts, array(
            CASE WHEN s.start >= a.at THEN concat(substring({text}, a.at + 1, s.start - a.at), '{left}', s.kind, '{right}') ELSE '' END)) AS parts),
        a -> concat(array_join(a.parts, ''), substring({text}, a.at + 1)))""")
    return find_spans(df, text_col, "__spans").withColumn(out, built).drop("__spans")


def pii_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, counts of the base kinds, base_sha256, spans."""
    slim = find_spans(df.select(F.col(id_col), F.col(text_col)), text_col, "found")
    base = [k.name for k in KINDS if k.base]
    joined = lambda only: f"""array_join(transform({'filter(found, s -> s.ord < ' + str(len(base)) + ')' if only else 'found'},
        s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"""  # noqa: E731
    return slim.select(
        id_col, *[F.expr(f"size(filter(found, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in base],
        F.sha2(F.expr(joined(True)), 256).alias("base_sha256"), F.expr(joined(False)).alias("spans"))
