"""Personal data: patterns propose, checksums confirm, words nearby adjust the score (operator 10).

SQL functions only. Base kinds stay whatever their score; added kinds need ``KEEP``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.spans import NEAR, Kind, find, report

# Patterns. Runs start where a run of their characters starts (or a match ended).
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    # The first word, and ahead of it the words that may belong to it and what is near them.
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{0,30}+(?![A-Za-z0-9])(?=((?:\x20[A-Z0-9]{1,30}+(?![A-Za-z0-9])){0,30}+(?s:.{0,40}+)))",
         r"[A-Z]{2}[0-9]{2}", base=False, ahead=True),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", base=False),
)
NAMES = [k.name for k in KINDS]
BASE = [k.name for k in KINDS if k.base]
# Words that speak for a kind when they stand near (lower case).
CONTEXT = {
    "email": "mail|e-mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|mastercard|credit|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "ssn": "ssn|social|security",
}
# Score: a proposal, what a checksum adds, what a word nearby adds.
PROPOSED, CHECKED, NEARBY, KEEP = 0.4, 0.4, 0.2, 0.6


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    turned = F.split(F.reverse(number), "")
    worth = F.transform(turned, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(iban: Column) -> Column:
    """Remainder by 97 of an account number, first four characters last, letters as 10 to 35."""
    plain = F.regexp_replace(iban, " ", "")
    chars = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(
        c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def account_number(text: Column) -> Column:
    """The longest part that ``text`` begins with, of whole words and 15 to 34 signs, that passes mod-97; else null."""
    words = F.split(F.regexp_extract(text, r"^[A-Z0-9]++(?:\x20[A-Z0-9]++(?![A-Za-z0-9]))*+", 0), " ")
    parts = F.transform(F.sequence(F.lit(1), F.lit(31)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    good = F.filter(parts, lambda p: F.when(F.length(F.replace(p, F.lit(" "), F.lit(""))).between(15, 34), mod97(p) == 1).otherwise(False))
    return F.get(good, F.size(good) - 1)


def _with_account_numbers(found: DataFrame) -> DataFrame:
    """``found`` with whole account numbers for their first words; what begins none has a null kind."""
    iban = F.col("kind") == NAMES.index("iban")
    whole = F.concat("match", "ahead")
    df = found.withColumn("number", F.when(iban, account_number(whole)))
    good = F.col("number").isNotNull()
    size = F.length("number")
    return (df.withColumn("kind", F.when(good | ~iban, F.col("kind")))
            .withColumn("after", F.when(good, F.substring(whole, size + 1, F.lit(NEAR))).otherwise(F.col("after")))
            .withColumn("stop", F.when(good, F.col("start") + size).otherwise(F.col("stop")))
            .withColumn("match", F.coalesce("number", "match")).drop("number"))


def _checked() -> Column:
    """Whether a proposal passes its kind's own check; null where a kind has none."""
    match, kind = F.col("match"), F.col("kind")
    n = F.length(digits(match))
    # A part is at most 255 whatever zeros lead it, so it is compared as text.
    small = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return (F.when(kind == NAMES.index("ip"), match.rlike(rf"^{small}(?:\.{small}){{3}}$"))
            .when(kind == NAMES.index("card"), luhn(digits(match)))
            .when(kind == NAMES.index("phone"), n.between(8, 15))
            .when(kind == NAMES.index("iban"), F.lit(True)))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, top_score.

    Base kinds: e-mail addresses, addresses of four parts up to 255, cards of 16 to 19 digits that
    pass Luhn, phone numbers of 8 to 15 digits. Added: account numbers, the longest run of words
    from their first one that passes mod-97, and social security numbers that have a word for them
    nearby. Spans are kind:start:stop in code
    points, by kind, then start. A null or empty text has no span; top_score is then null. Repeated
    rows are reported each. Other columns are ignored.
    """
    near = F.lower(F.concat_ws(" ", "before", "after"))
    words = F.array(*[F.lit(rf"(?<![a-z])(?:{CONTEXT[n]})(?![a-z])") for n in NAMES])
    checked = _checked()
    score = (F.lit(PROPOSED) + F.when(checked, CHECKED).otherwise(0.0)
             + F.when(F.rlike(near, F.get(words, F.col("kind"))), NEARBY).otherwise(0.0))
    found = _with_account_numbers(find(docs, KINDS)).withColumn("score", F.when(F.col("kind").isNotNull(), score))
    stays = F.coalesce(checked, F.lit(True)) & ((F.col("kind") < len(BASE)) | (F.col("score") >= KEEP))
    # What fails keeps its row with a null kind, for its document's sake.
    found = found.withColumn("_stays", stays)
    found = found.withColumn("kind", F.when(F.col("_stays"), F.col("kind"))).withColumn("score", F.when(F.col("_stays"), F.col("score")))
    return report(found, NAMES, BASE, ("kind", "start"), [F.round(F.max("score"), 3).alias("top_score")])
