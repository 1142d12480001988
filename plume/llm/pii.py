"""Personal data: regular expressions propose spans, checksums confirm them,
context words nearby adjust the score.

Kinds, in this order: email, ip (parts at most 255), card (13 to 19 digits,
Luhn), phone (9 to 15 digits) are always kept if valid.  Two more depend on
more evidence: iban (its country's length, compact or in groups of four, and
mod-97), and secret, a run of hexadecimal digits that only a context word
(password, token, ...) in the 24 characters before or behind it lifts above the
threshold; context does not reach over another match of the kind.  Spans of one
kind never overlap; those of different kinds may.

Scale: DataFrame operations only, one narrow pass, no shuffle.  A pattern runs
only on texts that hold a character it needs.  Patterns are written so that
each is linear in the text: possessive where nothing follows, and a mail
address starts only where no character of its first part stands before (or
where the last match ended).  Positions are running sums over the pieces
between matches, taken in blocks, so a text with very many spans does not cost
their square.

Defined cases: a null text has no span and stays null when masked; empty
texts, repeated rows and other columns need no care; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Characters before and behind a span in which context words count.
NEAR = 24
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    """A pattern, what a text must hold for it (a quick test), the score of a
    valid match, and context words that add ``lift``."""

    name: str
    pattern: str
    needs: str
    score: float
    context: tuple[str, ...]
    lift: float


# fixed values: the lengths of account numbers, by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    """Compact or in groups of four, as long as the country says."""
    forms = []
    for length, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        printed = rf"(?:\x20[A-Z0-9]{{4}}){{{groups}}}" + (rf"\x20[A-Z0-9]{{{rest}}}" if rest else "")
        forms.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{length - 4}}}|{printed})")
    return rf"(?<![A-Z0-9])(?:{'|'.join(forms)})"


# fixed values: the first four patterns match what the plain forms in the tests match
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         0.9, ("mail", "contact"), 0.1),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9]\\.[0-9]", 0.6, ("ip", "host", "server", "address"), 0.2),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "[0-9][\\x20-]?[0-9]", 0.8, ("card", "visa", "payment"), 0.2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", 0.7, ("phone", "tel", "call", "mobile"), 0.2),
    Kind("iban", _iban(), "[A-Z]{2}[0-9]{2}", 0.8, ("iban", "account", "bank"), 0.2),
    Kind("secret", r"[0-9a-f]{16,}+", "[0-9a-f]{16}", 0.3, ("password", "token", "secret", "key"), 0.6),
]
BASE = [k.name for k in KINDS[:4]]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """Remainder of an IBAN: the first four characters go last, letters count
    from 10."""
    moved = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(
        c == "", acc).when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return _mod97(F.replace(value, F.lit(" "), F.lit(""))) == 1
    return F.lit(True)


#: Items per block of a running sum or merge over an array.
BLOCK = 64


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _blocks(items: Column) -> Column:
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, F.lit(BLOCK)))


def _before(values: Column, combine) -> Column:
    """For each value what ``combine`` makes of all values before it (from 0)."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(values, begin, lambda acc, x: F.struct(
        combine(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])


def _spans(text: Column, kind: Kind) -> Column:
    """Valid spans of one kind with their scores, in order."""
    pieces = _let(F.split(text, kind.pattern, -1), lambda gaps: F.arrays_zip(
        gaps.alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("value"),
        F.slice(gaps, 2, F.size(gaps)).alias("behind")))
    found = F.filter(pieces, lambda p: p["value"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int,value:string,near:string>>")

    def size(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["value"]))

    def place(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["value"])
        span = F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"),
                        F.lower(F.concat(F.right(p["gap"], F.lit(NEAR)), F.lit("\n"), F.left(p["behind"], F.lit(NEAR)))).alias("near"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("spans")), place, lambda acc: acc["spans"])

    every = _let(_blocks(found), lambda blocks: F.flatten(
        F.zip_with(blocks, _before(F.transform(blocks, size), lambda a, n: a + n), placed)))
    valid = F.filter(every, lambda s: _valid(kind.name, s["value"]))

    def scored(s: Column) -> Column:
        hit = F.lit(False)
        for word in kind.context:
            hit = hit | F.contains(s["near"], F.lit(word))
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        F.when(hit, F.lit(kind.score + kind.lift)).otherwise(F.lit(kind.score)).alias("score"))

    kept = F.filter(F.transform(valid, scored), lambda s: s["score"] >= THRESHOLD)
    return F.when(text.rlike(kind.needs), kept).otherwise(F.array().cast(SPAN))


def spans(text: Column) -> Column:
    """All spans of a text (null counts as empty): array of (kind, start, end,
    score), code points, end exclusive, in the order of the kinds."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*(_spans(text, k).cast(SPAN) for k in KINDS))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets;
    overlapping spans become one, named after the first."""
    text = F.col("text")
    ordered = F.array_sort(F.transform(spans(text), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("until"), s["kind"].alias("kind"))))
    none = F.array().cast("array<string>")

    def reach(block: Column) -> Column:
        return F.array_max(F.transform(block, lambda s: -s["until"]))

    def put(acc: Column, s: Column) -> Column:
        end = -s["until"]
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        name = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], end).alias("at"),
                        F.when(s["start"] >= acc["at"], F.concat(acc["pieces"], F.array(between, name)))
                        .otherwise(acc["pieces"]).alias("pieces"))

    def pieces(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("pieces")), put, lambda acc: acc["pieces"])

    def masked(blocks: Column) -> Column:
        ends = F.transform(blocks, reach)
        parts = F.flatten(F.zip_with(blocks, _before(ends, F.greatest), pieces))
        rest = F.substring(text, F.array_max(ends) + 1, F.length(text))
        return F.when(F.size(blocks) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)

    return docs.withColumn("text", F.when(text.isNull(), text).otherwise(_let(ordered, lambda o: _let(_blocks(o), masked))))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts per kind and the spans as text."""
    found = docs.select("doc_id", spans(F.col("text")).alias("found"))
    listed = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")).alias("said")))
    found = found.select("doc_id", listed.alias("listed"))

    def said(keep) -> Column:
        return F.array_join(F.transform(F.filter("listed", keep), lambda s: s["said"]), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("listed", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(said(lambda s: s["kind"].isin(*BASE)), 256).alias("base_sha256"),
                        said(lambda s: F.lit(True)).alias("spans"))
