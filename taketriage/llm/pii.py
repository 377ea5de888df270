"""Personal data: patterns propose, checksums confirm, context adjusts.

Built of SQL functions only.  Matches are marked in the text with a control
character, the text is split at the marks, and lengths of the pieces add up to
offsets (code points, end exclusive).  The mark itself is replaced in the text
first; no pattern contains it.  Sums run over blocks of pieces, as many as a
block has, so a text with many matches takes little more than linear time.

Base kinds: email, ip, card (Luhn), phone.  Further kinds: iban (mod 97) and
ssn, the latter only where a context word raises its score to the threshold.
Scores go with the spans: a score per kind, more where a whole word of the
kind's list stands within NEAR code points before or after the span (not in
it), in either case of any alphabet.

A null text counts as empty; an empty text has no spans and the digest of the
empty string.  Repeated rows give repeated results; an empty table gives no
rows; other columns of any name are ignored; texts of any length are scanned
whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .shared import id_text

MARK, OTHER = "\x01", "\x02"
BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn")

#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI AX FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GG IE IM JE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI BL DJ FR GF GP GR IT MC MF MQ MR NC PF PM RE SM TF WF YT",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """The country's own length; any length only where that doesn't fit."""
    known = [
        f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f"\\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
        for n, codes in IBAN_LENGTHS.items()
    ]
    other = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
    end = "(?![A-Za-z0-9])"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{'|'.join(known)}){end}|{other}{end})"


# Possessive repeats and a start condition keep the matcher linear; \G lets a
# match begin where the last one ended, inside a run of the same characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must contain for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

#: Score of a confirmed span, what a context word adds, the least score of the
#: further kinds, and how many code points on either side count as near.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT_BONUS, THRESHOLD, NEAR = 0.25, 0.6, 40
WORDS = {
    "email": "e-?mail|mail|contact|write|correo|courriel",
    "ip": "ip|address|host|server|adresse|dirección",
    "card": "card|creditcard|visa|mastercard|credit|debit|payment|tarjeta|carte|karte|kreditkarte",
    "phone": "phone|telephone|cellphone|tel|call|mobile|fax|telefon|telefonnummer|téléphone|teléfono",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
}
#: The shortest match of a kind: so many can stand within NEAR.
SHORTEST = {"email": 5, "ip": 7, "card": 14, "phone": 10, "iban": 15, "ssn": 11}


def _context(kind: str) -> str:
    return rf"(?iu)(?<=[^\p{{L}}\p{{N}}])(?:{WORDS[kind]})s?(?=[^\p{{L}}\p{{N}}])"


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``x``, which is evaluated once however often it is used."""
    return F.transform(F.array(x), use)[0]


def _digits(x: Column) -> Column:
    return F.translate(x, " -().+", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of at most 19 digits (zeros before it count nothing)."""
    d = F.lpad(digits, 20, "0")
    place = lambda s, i: F.substring(s, i, 1).cast("int")
    twice = F.translate(d, "0123456789", "0246813579")
    total = sum((place(twice if i % 2 else d, i) for i in range(1, 21)), F.lit(0))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the rearranged number has remainder 1."""
    s = F.translate(iban, " ", "")
    s = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 58, (acc * 10 + v - 48) % 97).otherwise((acc * 100 + v - 55) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(x))
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return F.length(F.translate(x, " ", "")).between(15, 34) & mod97(x)
    if kind == "ssn":
        return ~x.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _offsets(pieces: Column) -> Column:
    """Where each piece begins: sums within blocks, over sums of blocks."""
    n = F.size(pieces)
    block = F.ceil(F.sqrt(n)).cast("int")
    running = "struct<at:long,out:array<long>>"

    def sums(lengths: Column, first: Column) -> Column:
        zero = F.struct(first.cast("long").alias("at"), F.array().cast("array<long>").alias("out")).cast(running)
        return F.aggregate(lengths, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")).cast(running))["out"]

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + x))
        return F.flatten(F.zip_with(blocks, sums(totals, F.lit(0)), sums))

    lengths = F.transform(pieces, lambda x: F.length(x).cast("long"))
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(x, b * block + 1, block))
    return _let(lengths, lambda x: _let(cut(x), over))


def _near(kind: str, pieces: Column, i: Column) -> Column:
    """What stands within NEAR of piece ``i``, a mark in its place, and one
    code point more on each side (or a mark at the end of the text), which
    tells whether a word goes on."""
    some = 2 * (NEAR // SHORTEST[kind]) + 1
    a = F.greatest(i - some, F.lit(0))
    before = F.array_join(F.transform(F.slice(pieces, a + 1, i - a), lambda x: F.right(x, F.lit(NEAR + 1))), "")
    after = F.array_join(F.transform(F.slice(pieces, i + 2, F.lit(some)), lambda x: F.left(x, F.lit(NEAR + 1))), "")
    return F.concat(F.right(F.concat(F.lit(MARK), before), F.lit(NEAR + 1)), F.lit(MARK), F.left(F.concat(after, F.lit(MARK)), F.lit(NEAR + 1)))


_SPAN = "struct<start:long,end:long,kind:string,score:double>"


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<start,end,kind,score>> of one kind, in order.

    ``text`` is free of the mark.  Pieces alternate: between matches, match.
    """
    marked = F.regexp_replace(text, F.lit(f"({PATTERNS[kind]})"), F.lit(f"{MARK}$1{MARK}"))
    none = F.array().cast(f"array<{_SPAN}>")

    def found(pieces: Column) -> Column:
        def span(starts: Column) -> Column:
            def one(j: Column) -> Column:
                i = 2 * j + 1
                start, more = F.get(starts, i), F.when(_near(kind, pieces, i).rlike(_context(kind)), CONTEXT_BONUS).otherwise(0.0)
                score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + more)
                return F.struct(start.alias("start"), (start + F.length(F.get(pieces, i))).alias("end"), F.lit(kind).alias("kind"), score.alias("score")).cast(_SPAN)

            every = F.sequence(F.lit(0), F.floor((F.size(pieces) - 3) / 2).cast("int"))
            return F.transform(F.filter(every, lambda j: valid(kind, F.get(pieces, 2 * j + 1))), one)

        return F.when(F.size(pieces) > 1, _let(_offsets(pieces), span)).otherwise(none)

    spans = _let(F.split(marked, MARK, -1), found)
    if kind in MORE:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    if kind in NEEDS:
        spans = F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(none)
    return spans


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans array<struct<start,end,kind,score>>,
    by start, then kind in the order of BASE and MORE."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, OTHER)
    text = F.when(F.contains(F.col("text"), F.lit(MARK)), text).otherwise(F.coalesce(F.col("text"), F.lit("")))
    kinds = BASE + MORE
    df = id_text(docs, id_col, text_col).select("doc_id", text.alias("text"))
    df = df.select("doc_id", *[spans_of(k, F.col("text")).alias(k) for k in kinds])
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    keyed = F.transform(F.concat(*kinds), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))
    back = F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))
    return df.select("doc_id", back.alias("spans"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of every text, from :func:`pii_spans`."""
    base = F.array(*map(F.lit, BASE))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return pii_spans(docs).select(
        "doc_id",
        *map(count, BASE),
        F.sha2(joined(F.filter("spans", lambda s: F.array_contains(base, s["kind"]))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
