"""Personal data in texts, with built-in expressions only.

Patterns propose spans, validators confirm them (Luhn for cards, mod-97 for bank accounts, ranges for addresses) and
words near a span adjust its score. Email, ip, card and phone spans that pass their validator always stay; bank accounts
(`iban`) and social security numbers (`ssn`) are added when their score reaches MIN_SCORE, which an unchecked number
does only near a context word.

Positions come from splitting at the pattern: a match starts after the pieces and matches before it. Patterns are
possessive and anchored at run starts, so that a text of one long run costs linear time. A bank account is looked for at
each start of one, whatever follows: of the ends of its groups the one with the country's length counts, or for a country
without a known length the last one that passes the check.

Defined results: a null text is empty; repeated rows give repeated rows; an empty table gives no rows; other columns are
kept by `find_spans` and ignored by `summary`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import let, prefix_sums

# The kinds in their order, patterns, context words and scores.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
LOCAL, DIGIT = "[A-Za-z0-9._%+-]", "[0-9]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
CONTEXT = {
    "email": "(e-?mail|contact|write)", "ip": r"(\bip\b|address|host|server)", "card": "(card|visa|credit|payment)", "phone": "(phone|tel|call|mobile)",
    "iban": "(iban|account|bank|konto|compte|cuenta)", "ssn": r"(ssn|social|security|\bid\b|tax)",
}
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.35}
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT",
}
CONTEXT_BONUS, MIN_SCORE, REACH = 0.3, 0.6, 40


def _mod97(m: Column) -> Column:
    """Remainder of a bank account number, its first four characters moved to the end and letters read as 10 to 35."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    def step(a: Column, c: Column) -> Column:
        return F.when(F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _account(m: Column) -> Column:
    """The bank account that a candidate begins with, or null: up to the end of one of its groups."""
    lengths = F.create_map(*[F.lit(x) for n, of in IBAN_LENGTHS.items() for c in of.split() for x in (c, n)])
    ends = F.filter(F.sequence(F.lit(15), F.length(m)), lambda i: (i == F.length(m)) | (F.substring(m, i + 1, F.lit(1)) == " "))
    ends = F.filter(ends, lambda i: let(F.length(F.regexp_replace(F.substring(m, F.lit(1), i), " ", "")), lambda n: (n >= 15) & (n == F.coalesce(lengths[F.substring(m, 1, 2)], n))))
    good = F.filter(F.transform(ends, lambda i: F.substring(m, F.lit(1), i)), lambda p: _mod97(p) == 1)
    return F.try_element_at(good, F.lit(-1))


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda v: (F.length(v) <= 3) & (F.lpad(v, 3, "0") <= "255")))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return m.isNotNull()
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """Valid matches of one kind as (start, ord, end, kind, score), positions in code points."""
    pattern, empty = PATTERNS[kind], "array<struct<start:bigint,ord:int,end:bigint,kind:string,score:double>>"

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
        whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _account) if kind == "iban" else found
        both = let(gaps, lambda g: let(prefix_sums(F.transform(found, lambda m, i: g[i] + F.length(m))), lambda at: let(whole, lambda w: F.transform(found, lambda m, i: F.struct((at[i] + g[i]).alias("start"), w[i].alias("m"))))))
        before = lambda s: F.substring(text, F.greatest(s["start"] - REACH + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(REACH)).cast("int"))
        after = lambda s: F.substring(text, (s["start"] + F.length(s["m"]) + 1).cast("int"), F.lit(REACH))
        near = lambda s: F.lower(F.concat_ws(" | ", before(s), after(s)))
        scored = F.transform(F.filter(both, lambda s: _valid(kind, s["m"])), lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), (s["start"] + F.length(s["m"])).alias("end"), F.lit(kind).alias("kind"),
            F.least(F.lit(1.0), SCORE[kind] + F.when(near(s).rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)).alias("score")))
        return (scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= MIN_SCORE)).cast(empty)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) > 0, placed(f)))
    worth = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    return F.coalesce(F.when(worth, found), F.array().cast(empty))


def find_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """The table with a column of spans, ordered by start and kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, F.array_sort(F.concat(*[_spans(k, body) for k in KINDS])))


def redact(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """The text with each base or added span replaced by its kind in brackets; of overlapping spans the first counts."""
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["done"], F.substring(body, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("done")))
    return docs.withColumn(text, F.aggregate(spans, start, step, lambda a: F.concat(a["done"], F.substring(body, (a["at"] + 1).cast("int"), 2_147_483_647))))


def summary(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and the list of all spans of each document."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    found = find_spans(docs.select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, BASE), F.sha2(joined(F.filter("pii", lambda s: s["ord"] < len(BASE))), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
