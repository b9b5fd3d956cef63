"""Personal data by patterns, checksums and context, in DataFrame functions only.

Patterns propose spans; the checksum of Luhn (cards) and the remainder by 97 (account numbers, IBAN) confirm them; words near a span
raise or lower its score. Base kinds email, ip, card and phone are kept whatever their score. The method adds ``iban`` spans, and ``local``
spans: phone numbers without country code, which only count where a word nearby says so.

An account number has the length of its country (``IBAN_LENGTHS``); one of another country ends at the last place, within 34 characters, where
no letter or digit follows.

Every pattern starts at a place where no earlier start could have matched and gives no characters back, or 19 at most, so the time is linear in
the text. Positions are code points: the gaps between matches are measured.

Defined results: null and empty texts have no spans; a null id stays null; repeated rows are repeated; other columns are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The patterns of the base kinds, with possessive loops and guarded starts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Lengths of account numbers by country: words and numbers behind a number are not part of it.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
                22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
                27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_BY_LENGTH = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items())
_KNOWN = "(?:" + "|".join(IBAN_LENGTHS.values()).replace(" ", "|") + ")[0-9]{2}"
#: Other countries: as far as the characters go, up to 34, but not into a word that does not fit or another number.
IBAN = (rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_BY_LENGTH}|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{_KNOWN}))?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])")
LOCAL = r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])"
#: Kind, pattern, a cheap test whether the text can hold one, score without context, words that raise it.
KINDS = (
    ("email", EMAIL, "@", 0.9, r"(?i)e-?mail|contact|address|write|adresse|correo|courriel"),
    ("ip", IP, None, 0.6, r"(?i)\bip\b|host|server|address|login|client"),
    ("card", CARD, None, 0.7, r"(?i)card|visa|credit|payment|karte|carte|tarjeta"),
    ("phone", PHONE, "+", 0.8, r"(?i)phone|\btel\b|call|mobile|fax|telefon|móvil"),
    ("iban", IBAN, None, 0.8, r"(?i)iban|account|bank|konto|compte|cuenta"),
    ("local", LOCAL, None, 0.3, r"(?i)phone|\btel\b|call|mobile|fax|telefon|móvil"),
)
#: Code points on either side of a span in which context words count.
NEAR = 40
CONTEXT_GAIN, LEAST_SCORE = 0.3, 0.5


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the checksum of Luhn."""
    at = lambda k: F.substring(digits, k, F.lit(1)).cast("int")
    n = F.length(digits)

    def add(total, k):
        d = at(k)
        twice = F.pmod(n - k, F.lit(2)) == 1
        return total + F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10)) == 0


def _remainder97(code: Column) -> Column:
    """Remainder of an account number by 97: first four characters moved to the end, letters as 10 .. 35."""
    plain = F.regexp_replace(code, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda r, c: F.pmod(r * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97))
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.concat(F.lit("0"), F.regexp_replace(p, "^0+", ""))
        return ~F.exists(F.split(match, r"\."), lambda p: (F.length(short(p)) > 4) | (F.substring(short(p), 1, 4).cast("int") > 255))
    if kind == "card":
        d = _digits(match)
        return F.length(d).between(13, 19) & _luhn(F.substring(d, 1, 19))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _remainder97(match) == 1
    return F.lit(True)


def spans_of(text: Column, pattern: str, possible: Column) -> Column:
    """Array of (start, end, value) of the matches of a pattern, in code points. ``possible``: a cheaper test that holds for texts with a match."""
    empty = F.array().cast("array<string>")
    matches = F.when(possible, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).otherwise(empty)
    gaps = F.when(possible, F.split(text, pattern)).otherwise(empty)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(state, pair):
        start = (state["at"] + F.length(pair["gap"])).cast("int")
        end = (start + F.length(pair["match"])).cast("int")
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), pair["match"].alias("value")))).alias("out"))
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), lambda p: p["match"].isNotNull())
    return F.aggregate(pairs, begin, step, lambda s: s["out"])


def _found(text: Column, kind: str, pattern: str, test: str | None, score: float, context: str) -> Column:
    """Array of (kind, start, end, score, value) of one kind in a text."""
    spans = spans_of(text, pattern, text.contains(test) if test else text.rlike(pattern))
    kept = F.filter(spans, lambda s: _valid(kind, s["value"]))
    around = lambda s: F.concat(
        F.substring(text, F.greatest(s["start"] - NEAR + 1, F.lit(1)), F.least(F.lit(NEAR), s["start"])), F.lit(" "),
        F.substring(text, s["end"] + 1, F.lit(NEAR)))
    scored = F.transform(kept, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        F.least(F.lit(1.0), F.when(around(s).rlike(context), F.lit(score + CONTEXT_GAIN)).otherwise(F.lit(score))).alias("score")))
    return F.filter(scored, lambda s: s["score"] >= LEAST_SCORE) if kind == "local" else scored


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end, value, score), by kind as in ``KINDS``, then by start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.col("doc_id"), *[_found(text, *k).alias(f"_{k[0]}") for k in KINDS])
    return found.select("doc_id", F.concat(*[F.col(f"_{k[0]}") for k in KINDS]).alias("spans"))
