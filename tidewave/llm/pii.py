"""Private data replaced by format-preserving Feistel pseudonyms. DataFrame functions only.

One pattern finds candidates in the whole text; each is validated by its kind (check digit, octets, calendar) and then
permuted within its format by a keyed Feistel network, so the same value gets the same pseudonym in every document and
different values get different ones; a valid number becomes a valid one. What can't be permuted (addresses, secrets)
gets a keyed digest in its own shape. Telephone numbers are those of ten digits with separators and an optional prefix;
they have no check digit, so their shape is all that is validated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents

ROUNDS = 10

#: Days of 400 Gregorian years, the domain of dates, as a product of the two halves' moduli.
DATE_MODULI, FIRST_DAY, LAST_DAY = (189, 773), "1800-01-01", "2199-12-31"

PATTERNS = (
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",  # e-mail address
    r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)",  # IPv4 address
    r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])",  # ISO date
    r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",  # social security number
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?![\w])",  # telephone number
    r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)",  # payment card
    r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3})[\"']?[\w/+.-]{16,}+[\"']?",  # secret
)
CANDIDATE = "|".join(PATTERNS)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def prf(key: str, *parts: Column) -> Column:
    """60 keyed pseudo-random bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, mod_a: Column, b: Column, mod_b: Column, key: str, tweak: Column) -> Column:
    """struct(a, b), a keyed permutation of the pairs below (mod_a, mod_b). Each round adds a keyed value of one half to the other."""
    state = F.struct(a.cast("long").alias("a"), mod_a.cast("long").alias("ma"), b.cast("long").alias("b"), mod_b.cast("long").alias("mb"))
    return F.aggregate(  # ROUNDS is even, so the halves end in their places
        F.lit(list(range(ROUNDS))),
        state,
        lambda s, r: F.struct(s["b"].alias("a"), s["mb"].alias("ma"), ((s["a"] + prf(key, tweak, r, s["b"]) % s["ma"]) % s["ma"]).alias("b"), s["ma"].alias("mb")),
    )


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of 2 to 18 digits as another of the same length."""
    return bound(digits, lambda d: _permuted(d, key, kind))


def _permuted(digits: Column, key: str, kind: str) -> Column:
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    ends = feistel(F.substring(digits, F.lit(1), left).cast("long"), power(left), F.substring(digits, left + 1, n - left).cast("long"), power(n - left), key, F.concat(F.lit(kind), n.cast("string")))
    return bound(ends, lambda e: F.concat(F.lpad(e["a"].cast("string"), left, "0"), F.lpad(e["b"].cast("string"), n - left, "0")))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string; a multiple of ten if the last digit is right."""


    def add(s: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(s["twice"], 2).otherwise(1)
        return F.struct((s["sum"] + d - F.when(d > 9, 9).otherwise(0)).alias("sum"), (~s["twice"]).alias("twice"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("twice")), add)["sum"]


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits, from left to right, replaced by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def step(own: Column, s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(own, s["i"], F.lit(1))).otherwise(c)).alias("out"), (s["i"] + is_digit.cast("int")).alias("i"))

    return bound(digits, lambda own: F.aggregate(F.split(value, ""), start, lambda s, c: step(own, s, c))["out"])


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, value) of a candidate; the kind is null, and the value the candidate itself, if it isn't valid."""
    return bound(F.regexp_replace(m, r"\D", ""), lambda digits: _pseudonym(m, digits, key))


def _pseudonym(m: Column, digits: Column, key: str) -> Column:
    n = F.length(digits)

    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    is_ip = m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    ip_ok = F.forall(octets, lambda x: x <= 255)
    halves = feistel(octets[0] * 256 + octets[1], F.lit(65536), octets[2] * 256 + octets[3], F.lit(65536), key, F.lit("ip"))
    ip = bound(halves, lambda h: F.concat_ws(".", F.floor(h["a"] / 256), h["a"] % 256, F.floor(h["b"] / 256), h["b"] % 256))

    day = F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")
    is_date = m.rlike(r"^\d{4}-\d{2}-\d{2}$")
    date_ok = day.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))
    nth = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    moved = feistel(F.floor(nth / DATE_MODULI[1]), F.lit(DATE_MODULI[0]), nth % DATE_MODULI[1], F.lit(DATE_MODULI[1]), key, F.lit("date"))
    date = bound(moved, lambda h: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (h["a"] * DATE_MODULI[1] + h["b"]).cast("int")), "yyyy-MM-dd"))

    body = permute_digits(F.substring(digits, F.lit(1), n - 1), key, "card")
    card = refill(m, bound(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))))

    area, group, serial = (F.substring(digits, *at).cast("long") for at in ((1, 3), (4, 2), (6, 4)))
    ssn_ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    # valid numbers by their place: 898 areas, and 99 groups of 9999 numbers
    put = feistel(area - 1 - (area > 666).cast("long"), F.lit(898), (group - 1) * 9999 + serial - 1, F.lit(99 * 9999), key, F.lit("ssn"))
    ssn = bound(put, lambda h: F.format_string("%03d-%02d-%04d", h["a"] + 1 + (h["a"] >= 665).cast("long"), F.floor(h["b"] / 9999) + 1, h["b"] % 9999 + 1))

    phone = refill(m, F.concat(F.substring(digits, F.lit(1), n - 10), permute_digits(F.substring(digits, n - 9, F.lit(10)), key, "phone")))

    token = F.regexp_extract(m, r"[\w/+.-]{16,}", 0)
    secret = F.replace(m, token, F.substring(F.repeat(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), token), 256), F.ceil(F.length(token) / 64).cast("int")), F.lit(1), F.length(token)))
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    email = F.concat(F.lit("user."), F.substring(digest, 1, 32), F.lit("@mail.invalid"))  # 128 bits

    as_kind = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return (
        F.when(m.contains("@"), as_kind("email", email))
        .when(is_ip & ip_ok, as_kind("ip", ip))
        .when(is_date & date_ok, as_kind("date", date))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$") & ssn_ok, as_kind("ssn", ssn))
        .when(m.rlike(r"[=:]"), as_kind("secret", secret))
        .when(m.rlike(r"[ .)-]\d{3}[ .-]\d{4}$") & n.between(10, 13), as_kind("phone", phone))
        .when(m.rlike(r"^\d[\d -]+$") & n.between(13, 19) & (luhn_sum(digits) % 10 == 0), as_kind("card", card))
        .otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))
    )


def replaced(text: Column, key: str) -> Column:
    """struct(text, kinds): the text with pseudonyms, and the kinds of what was found, in order. The text is null if nothing was."""
    values = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda m: pseudonym(m, key))

    def joined(found: Column) -> Column:
        kinds = F.filter(F.transform(found, lambda v: v["kind"]), lambda k: k.isNotNull())
        between = F.split(text, CANDIDATE, -1)
        parts = F.zip_with(between, found, lambda b, v: F.concat(b, F.coalesce(v["value"], F.lit(""))))
        return F.struct(F.when(F.size(kinds) > 0, F.concat_ws("", parts)).alias("text"), kinds.alias("kinds"))

    return bound(values, joined)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs``, all its columns, with ``text`` rewritten, and ``private_kinds``: the kinds found, in order.

    The work of a row depends on that row alone, so rows that repeat, ties and skew need no care; there is no shuffle.
    A null text stays null with no kinds; an empty one stays empty; an empty table stays empty. A column of the input
    named ``private_kinds`` is replaced. n_chars, where the table has it, follows the new text.
    """
    # most texts hold no digit, @, = or : and are not searched further
    suspect = F.col("text").rlike("[0-9@=:]")
    own = "found" + "_" * max(map(len, docs.columns))  # no column's name
    found = docs.withColumn(own, F.when(suspect, replaced(F.col("text").cast("string"), key)))
    kinds = F.coalesce(f"{own}.kinds", F.array().cast("array<string>"))
    out = found.withColumn("private_kinds", kinds).withColumn("text", F.coalesce(f"{own}.text", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.drop(own)


def private_documents(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms (null: empty), n_private and private_kinds, one row for each row of ``docs``."""
    return pseudonymise(documents(docs), key).select("doc_id", "text", F.size("private_kinds").alias("n_private"), "private_kinds")
