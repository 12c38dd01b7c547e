"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Only Spark SQL functions: each pattern splits the text, and running sums over the lengths of the pieces and of
the matches give the positions. Parts of a text are cut out of its chunks, so that work is linear in the text and in its matches.
Work is local to a row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

#: Base kinds, in the order in which ties are listed. The patterns are written so that a search
#: is linear in the text (possessive runs, no start inside a run that already failed); what
#: they match equals the plain forms
#:   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#:   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#:   card  [0-9]([ -]?[0-9])+
#:   phone \+[0-9][ ().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO EG GT HU LB PL SV", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Of each country just so many characters, so that words that follow are no part of the number."""
    return "|".join(rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())


#: Added kinds; each needs its checksum, or a context word nearby.
ADDED = {
    "iban": rf"(?<![A-Za-z0-9])(?:{_iban_pattern()})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
KINDS = [*BASE, *ADDED]
#: Score before context; a context word within REACH characters adds CONTEXT.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3}
CONTEXT_WORDS = {
    "email": "mail|contact|write|correo|courriel", "ip": "ip|host|server|address|addr", "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon", "iban": "iban|account|konto|compte|cuenta|bank", "ssn": "ssn|social|security", "local_phone": "phone|tel|call|mobile|fax|telefon",
}
REACH, CONTEXT, THRESHOLD = 40, 0.2, 0.5

SPAN = "struct<kind:string,start:int,end:int,score:double>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    back = F.reverse(digits)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes the mod-97 check: four leading characters to the end, letters as 10 to 35."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = lambda i: F.ascii(F.substring(moved, i, F.lit(1)))
    rest = F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), lambda a, i: F.when(value(i) < 65, (a * 10 + value(i) - 48) % 97).otherwise((a * 100 + value(i) - 55) % 97))
    return rest == 1


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        # leading zeros do not count; more than three digits are over 255
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(found, r"\."), lambda p: F.when(F.length(part(p)) <= 3, F.lpad(part(p), 3, "0") <= "255").otherwise(False))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(found)
    return F.lit(True)


#: Code points of a chunk of text, as a power of two, and items that a scan folds at once, as a power of two.
CHUNK_BITS, FOLD_BITS = 10, 8


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(items: Column, carry: Column, out: str, step) -> Column:
    """An output (of SQL type `out`) for each item, from a value that is carried on: step(carry, item) -> (next carry, output).

    Folds copy their arrays as they grow; here they grow in short blocks, and then block by block.
    """

    def blocks(items: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.shiftright(F.size(items) - 1, FOLD_BITS), F.lit(0))), lambda i: F.slice(items, i * (1 << FOLD_BITS) + 1, F.lit(1 << FOLD_BITS)))

    def one(s: Column, x: Column) -> Column:
        after, output = step(s.c, x)
        return F.struct(after.alias("c"), F.array_append(s.o, output).alias("o"))

    def block_of(s: Column, block: Column) -> Column:
        folded = F.aggregate(block, F.struct(s.c.alias("c"), _empty(out).alias("o")), one)
        return _bound(folded, lambda r: F.struct(r.c.alias("c"), F.array_append(s.o, r.o).alias("o")))

    return F.flatten(F.aggregate(_bound(items, blocks), F.struct(carry.alias("c"), _empty(f"array<{out}>").alias("o")), block_of, lambda s: s.o))


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CHUNK_BITS}}}"), F.lit(0))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start (from 0) to end, exclusive, of the chunks' text."""
    first, last = F.shiftright(start, CHUNK_BITS), F.shiftright(end, CHUNK_BITS)
    return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * (1 << CHUNK_BITS) + 1, end - start)


def _spans(text: Column, chunks: Column, hits: Column, kind: str, pattern: str, reach: int) -> Column:
    """All valid matches of one kind, as SPAN structs in order; positions in code points, end exclusive."""
    lengths = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))
    starts = _scan(lengths, F.lit(0), "int", lambda at, p: (at + p.gap + F.coalesce(p.hit, F.lit(0)), at + p.gap))
    found = F.filter(F.zip_with(hits, F.slice(starts, F.lit(1), F.size(hits)), lambda hit, at: F.struct(hit.alias("hit"), at.alias("start"))), lambda s: _valid(kind, s.hit))

    def score(s: Column) -> Column:
        end = s.start + F.length(s.hit)
        near = F.lower(F.concat(_cut(chunks, F.greatest(s.start - reach, F.lit(0)), s.start), F.lit(" "), _cut(chunks, end, end + reach))).rlike(rf"\b(?:{CONTEXT_WORDS[kind]})")
        return F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near, CONTEXT).otherwise(0.0))

    spans = F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), (s.start + F.length(s.hit)).alias("end"), score(s).alias("score")))
    return F.when(F.size(hits) > 0, spans).otherwise(_empty(SPAN))


def _reaches(base: Column) -> Column:
    """Of spans in order of their starts, (start, greatest end so far)."""
    return _scan(base, F.lit(0), "struct<start:int,end:int>", lambda end, s: (F.greatest(end, s.end), F.struct(s.start.alias("start"), F.greatest(end, s.end).alias("end"))))


def _overlaps(span: Column, reaches: Column) -> Column:
    """Whether a span meets one of those behind `reaches`: of those that start before its end, by binary search, the one that ends last."""
    middle = lambda s: F.shiftright(s.lo + s.hi, 1)
    step = lambda s, _: F.when(s.lo >= s.hi, s).otherwise(
        F.when(F.get(reaches, middle(s)).start < span.end, F.struct((middle(s) + 1).alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), middle(s).alias("hi")))
    )
    n = F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct(F.lit(0).alias("lo"), F.size(reaches).alias("hi")), step, lambda s: s.lo)
    return F.coalesce(F.get(reaches, n - 1).end > span.start, F.lit(False))


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, reach: int = REACH) -> DataFrame:
    """The input and the column `pii`: an array of (kind, start, end, score), by start, then by kind as listed.

    * Base kinds stay whatever their score; added kinds stay from the threshold on, where they
      overlap no base span.
    * Null text is the empty text: an empty array. Texts are searched whole.
    * Other columns pass unchanged (a column named `pii` is replaced). Repeated rows are each searched.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    patterns = BASE | ADDED
    # the row is one column, so that no name of it can clash; each pattern's matches are another, so that it runs once where there are none
    kept = [c for c in docs.columns if c.lower() != "pii"]
    hits = {k: F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_h_{k}") for k, p in patterns.items()}
    out = docs.select(F.struct(*[column(c) for c in kept]).alias("_row"), text.alias("_text"), *hits.values())
    some = F.greatest(*[F.size(f"_h_{k}") for k in patterns]) > 0
    out = out.withColumn("_chunks", F.when(some, _chunks(F.col("_text"))).otherwise(_empty("string")))
    out = out.select("_row", *[_spans(F.col("_text"), F.col("_chunks"), F.col(f"_h_{k}"), k, p, reach).alias(f"_{k}") for k, p in patterns.items()])
    by_start = lambda spans, first: F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(s.start.alias("a"), first(s).alias("b"), s.alias("s")))), lambda k: k.s)
    out = out.select("_row", F.concat(*[F.col(f"_{k}") for k in BASE]).alias("_base"), F.filter(F.concat(*[F.col(f"_{k}") for k in ADDED]), lambda s: s.score >= threshold).alias("_added"))
    out = out.withColumn("_reaches", F.when(F.size("_added") > 0, _reaches(by_start(F.col("_base"), lambda s: s.end))).otherwise(_empty("struct<start:int,end:int>")))
    rank = F.array(*[F.lit(k) for k in KINDS])
    spans = F.concat("_base", F.filter("_added", lambda s: ~_overlaps(s, F.col("_reaches"))))
    return out.select(*[column(c, "_row").alias(c) for c in kept], by_start(spans, lambda s: F.array_position(rank, s.kind)).alias("pii"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input of find_pii() with each of its spans replaced by [KIND]; of overlapping spans the first counts.

    Null text becomes the empty text; a text without spans stays as it is. Repeated rows, null ids and other columns pass unchanged.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("_row"), F.col("pii").alias("_pii"), text.alias("_text"))
    rows = rows.withColumn("_chunks", F.when(F.size("_pii") > 0, _chunks(F.col("_text"))).otherwise(_empty("string")))
    # of overlapping spans the first: where it starts, where the text before it starts, its kind
    step = lambda at, s: (F.when(s.start < at, at).otherwise(s.end), F.when(s.start >= at, F.struct(at.alias("since"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    rows = rows.withColumn("_spans", F.array_compact(_scan(F.col("_pii"), F.lit(0), "struct<since:int,start:int,end:int,kind:string>", step)))
    pieces = F.transform("_spans", lambda s: F.concat(_cut(F.col("_chunks"), s.since, s.start), F.lit("["), F.upper(s.kind), F.lit("]")))
    rest = _cut(F.col("_chunks"), F.element_at("_spans", -1).end, F.length("_text"))
    clean = F.when(F.size("_spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("_text"))
    return rows.select(*[(clean.alias(c) if c.lower() == text_col.lower() else column(c, "_row").alias(c)) for c in docs.columns])
