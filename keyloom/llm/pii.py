"""Personal data in texts: regular expressions propose spans, checksums confirm them, context words score them.

Native operations only, row by row: nothing is shuffled. The patterns are
written with possessive quantifiers and look-behinds, which leave what they
match as it is and keep the search linear in the length of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_or_empty

#: Characters before and after a span in which context words count, up to the next span of its kind.
BEFORE, AFTER = 48, 24
#: Least score of a span of the kinds that context decides.
ACCEPT = 0.6
#: What a nearby context word adds to a score.
NEAR = 0.3

SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A quick necessary condition on the whole text.
    maybe: str
    #: Score of a confirmed span before context words.
    score: float
    context: str
    base: bool = True


# The length of an IBAN, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = r"(?<![A-Z0-9])(?:" + "|".join(rf"(?:{of.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, of in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"

#: In the order in which spans of one start are listed; the base kinds come first.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"mail|contact|write|e-mail"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.7, r"\bip\b|address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.7, r"card|visa|master|amex|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, r"phone|tel\b|call|mobile|fax|whatsapp"),
    Kind("iban", _IBAN, r"[A-Z]{2}[0-9]{2}", 0.7, r"iban|bank|konto|compte|cuenta|account", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.4, r"ssn|social security|social-security", base=False),
    Kind("local_phone", r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])", r"[0-9]{3}[-.][0-9]{4}", 0.4, r"phone|tel\b|call|mobile|fax|whatsapp", base=False),
)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN, without blanks, leaves 1 by 97 once its first four characters go last and letters count 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    each = F.filter(F.split(turned, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(each, F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return hit.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        number = digits(hit)
        return F.length(number).between(14, 19) & luhn(number)
    if kind == "phone":
        return F.length(digits(hit)).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(hit, " ", ""))
    if kind == "ssn":
        return ~hit.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


_PLACED = "struct<start:bigint,end:bigint,hit:string,near:string>"
#: Matches whose places are summed up at a time.
_PIECE = 256


def _placed(pairs: Column) -> Column:
    """Places of matches from their lengths and those of the gaps before them.

    The sums run over pieces, then within each: a text with very many matches
    would else copy its list of places once for each.
    """

    def sums(lengths: Column, start: Column, made) -> Column:
        def add(acc: Column, x: Column) -> Column:
            return F.struct((acc.pos + x.gap + x.chars).alias("pos"), F.concat(acc.out, F.array(made(acc.pos, x))).alias("out"))

        kind = "array<bigint>" if made is _position else f"array<{_PLACED}>"
        return F.aggregate(lengths, F.struct(start.cast("long").alias("pos"), F.array().cast(kind).alias("out")), add, lambda acc: acc.out)

    def by_piece(pieces: Column) -> Column:
        totals = F.transform(pieces, lambda c: F.struct(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x.gap + x.chars).alias("gap"), F.lit(0).cast("long").alias("chars")))
        return F.flatten(F.zip_with(pieces, sums(totals, F.lit(0), _position), lambda c, at: sums(c, at, _place)))

    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _PIECE).cast("int")), lambda i: F.slice(p, i * _PIECE + 1, _PIECE))
    return F.get(F.transform(F.transform(F.array(pairs), cut), by_piece), 0)


def _position(at: Column, x: Column) -> Column:
    return at


def _place(at: Column, x: Column) -> Column:
    start = at + x.gap
    return F.struct(start.alias("start"), (start + x.chars).alias("end"), x.hit.alias("hit"), x.near.alias("near"))


def _found(text: Column, kind: Kind) -> Column:
    """``array<struct<kind,start,end,score>>`` of a kind's confirmed spans, in code points, end exclusive.

    A text is cut at its matches, so where they start follows from the lengths
    of what lies between, which also has the context words; a match that fails
    its check is passed over.
    """
    measured = lambda g, m: F.struct(
        F.length(g.gap).cast("long").alias("gap"), F.length(m).cast("long").alias("chars"), m.alias("hit"), F.concat_ws(" ", F.right(g.gap, F.lit(BEFORE)), F.left(g.next, F.lit(AFTER))).alias("near")
    )

    def of(gaps: Column) -> Column:
        matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
        before, after = F.slice(gaps, 1, F.size(gaps) - 1), F.slice(gaps, 2, F.size(gaps) - 1)
        pairs = F.zip_with(F.arrays_zip(before.alias("gap"), after.alias("next")), matches, measured)
        return F.when(F.size(gaps) > 1, _placed(pairs)).otherwise(F.array().cast(f"array<{_PLACED}>"))

    spans = F.filter(F.get(F.transform(F.array(F.split(text, kind.pattern)), of), 0), lambda s: _valid(kind.name, s.hit))

    def scored(s: Column) -> Column:
        score = F.lit(kind.score) + F.when(F.lower(s.near).rlike(kind.context), NEAR).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s.start.alias("start"), s.end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    out = F.transform(spans, scored)
    if not kind.base:
        out = F.filter(out, lambda s: s.score >= ACCEPT)
    return F.when(text.rlike(kind.maybe), out).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs(doc_id, text)``: ``array<struct<kind,start,end,score>>``.

    Spans are in order of start, then kind as in ``KINDS``; places are in code
    points of the whole text, the end exclusive. Spans of the base kinds all
    stay, whatever they score; of the others those that score at least
    ``ACCEPT`` and don't lie wholly in a base span. Null and empty texts have none, repeated
    rows count as they stand, an empty table gives no rows; other columns are
    not read.
    """
    return _with_spans(docs.select("doc_id", text_or_empty().alias("text")), "spans").select("doc_id", "spans")


def _with_spans(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the spans of their ``text`` as a column of that name."""
    own = {k.name: free_name(f"found_{k.name}", docs.columns) for k in KINDS}
    docs = docs.select("*", *[_found(F.coalesce("text", F.lit("")), k).alias(own[k.name]) for k in KINDS])
    base = F.concat(*[F.col(own[k.name]) for k in KINDS if k.base])
    more = [F.filter(own[k.name], lambda s: ~F.exists(base, lambda b: (b.start <= s.start) & (s.end <= b.end))) for k in KINDS if not k.base]
    order = F.array(*[F.lit(k.name) for k in KINDS])
    listed = F.transform(F.concat(base, *more), lambda s: F.struct(s.start.alias("start"), F.array_position(order, s.kind).alias("n"), s.alias("span")))
    return docs.withColumn(name, F.transform(F.sort_array(listed), lambda s: s.span))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets; overlapping spans are one, named by the first.

    The spans are those of ``find_pii``. All columns keep their names and, but
    for text, their values, a column ``spans`` too; a null text stays null;
    repeated rows stay; an empty table gives no rows.
    """
    name = free_name("spans", docs.columns)
    start = F.struct(F.lit(0).cast("long").alias("till"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        told = F.concat(a.out, F.substring("text", (a.till + 1).cast("int"), (s.start - a.till).cast("int")), F.lit("["), s.kind, F.lit("]"))
        return F.struct(F.greatest(a.till, s.end).alias("till"), F.when(s.start < a.till, a.out).otherwise(told).alias("out"))

    replaced = F.aggregate(name, start, step, lambda a: F.concat(a.out, F.substring("text", (a.till + 1).cast("int"), F.lit(2**31 - 1))))
    full = _with_spans(docs.withColumn("text", F.col("text").cast("string")), name)
    return full.select(*[F.col(f"`{c}`") if c != "text" else F.when(F.col("text").isNotNull(), replaced).alias("text") for c in docs.columns])
