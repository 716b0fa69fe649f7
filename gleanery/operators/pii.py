"""Personal data: patterns, checks and context, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns, their expected share of false positives, base
# confidence, and words nearby that speak for and against a match.
IBAN_COUNTRIES = (
    "AL|AD|AT|AZ|BH|BY|BE|BA|BR|BG|CR|HR|CY|CZ|DK|DO|TL|EG|SV|EE|FO|FI|FR|GE|DE|GI|GR|GL|GT|HU|IS|IQ|IE|IL|IT|JO|KZ|XK|KW|LV|LB|LY|LI|LT|LU|"
    "MK|MT|MR|MU|MC|MD|ME|NL|NO|OM|PK|PS|PL|PT|QA|RO|LC|SM|SO|ST|SA|RS|SC|SK|SI|ES|SD|SE|CH|TN|TR|UA|AE|GB|VA|VG"
)


@dataclass(frozen=True)
class Pattern:
    name: str
    label: str
    regex: str
    fp_rate: float = 0.0
    base: float = 1.0
    boost: tuple[str, ...] = ()
    suppress: tuple[str, ...] = ()


#: What belongs to a built-in pattern (what lines need, its check) goes by the whole pattern,
#: so that one of the caller's own may have any name.
PATTERNS = [
    Pattern("email", "Email Address", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0.10, 0.8, ("email", "e-mail", "contact", "mailto")),
    Pattern(
        "credit_card", "Credit Card Number",
        r"\b(?:4\d{3}|5[1-5]\d{2}|2(?:2[2-9]\d|[3-6]\d{2}|7[01]\d|720)|3[47]\d{2}|6(?:011|5\d{2})|3(?:0[0-5]|[68]\d)\d)[ -]?(?:\d[ -]?){8,14}\d\b", 0.15, 0.7,
        ("card", "credit", "payment", "billing", "visa", "mastercard"), ("order", "tracking", "serial", "reference"),
    ),
    Pattern(
        "ssn", "SSN (US)", r"(?<![#\w])(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!\w)", 0.30, 0.5, ("social security", "ssn", "taxpayer", "tax id", "social sec"),
        ("order", "invoice", "tracking", "serial", "reference", "part", "model", "item", "sku", "code"),
    ),
    Pattern(
        "phone", "Phone Number", r"(?<![#\w])(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b", 0.50, 0.4, ("phone", "call", "tel", "mobile", "cell", "fax", "contact"),
        ("order", "item", "sku", "zip", "postal", "code", "part"),
    ),
    Pattern("ip_address", "IP Address (IPv4)", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0.15, 0.6, ("ip", "host", "server", "network", "address", "dns"), ("version",)),
    Pattern(
        "ipv6_address", "IP Address (IPv6)",
        r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b|\b::(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}\b", 0.15, 0.6,
        ("ip", "host", "server", "network", "address", "dns", "ipv6"), ("version",),
    ),
    Pattern("iban", "IBAN (International)", rf"\b(?:{IBAN_COUNTRIES})\d{{2}}[A-Z0-9]{{11,30}}\b", 0.15, 0.6, ("iban", "bank", "account", "transfer", "payment", "swift", "bic"), ("serial", "reference", "order", "tracking")),
    Pattern("uk_nino", "UK National Insurance Number", r"\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]\b", 0.25, 0.5, ("national insurance", "nino", "ni number", "tax", "hmrc"), ("serial", "reference", "order", "model")),
    Pattern("de_tax_id", "German Tax ID (Steuer-IdNr)", r"\b[1-9]\d{10}\b", 0.35, 0.3, ("steuer", "tax", "finanzamt", "identifikationsnummer", "idnr"), ("phone", "zip", "postal", "order", "serial", "isbn")),
    Pattern("es_dni", "Spanish DNI", r"\b\d{8}[A-Z]\b", 0.30, 0.5, ("dni", "documento", "identidad", "nie", "nif"), ("order", "reference", "serial", "code", "postal")),
    Pattern("btc_address", "Bitcoin Address", r"\b(?:[13][A-HJ-NP-Za-km-z1-9]{25,34}|bc1[a-z0-9]{6,87})\b", 0.20, 0.5, ("wallet", "bitcoin", "btc", "crypto", "address", "transaction", "tx"), ("hash", "commit", "sha", "checksum")),
    Pattern("eth_address", "Ethereum Address", r"\b0x[0-9a-fA-F]{40}\b", 0.10, 0.6, ("wallet", "ethereum", "eth", "crypto", "address", "transaction", "tx", "contract"), ("hash", "commit", "sha", "checksum")),
]
#: What a line must hold for a pattern to match in it; cheap to look for, and most lines have none of it.
NEEDS = {
    "email": "@", "credit_card": r"\p{Nd}{3}", "ssn": r"\p{Nd}-\p{Nd}", "phone": r"\p{Nd}{3}", "ip_address": r"\p{Nd}\.[\p{Nd}]", "ipv6_address": "[0-9a-fA-F]*:[0-9a-fA-F]*:",
    "iban": r"[A-Z]{2}\p{Nd}{2}", "uk_nino": r"[A-Z]{2}\p{Nd}{6}", "de_tax_id": r"[1-9]\p{Nd}{10}", "es_dni": r"\p{Nd}{8}[A-Z]", "btc_address": "[13][A-HJ-NP-Za-km-z1-9]{25}|bc1", "eth_address": "0x[0-9a-fA-F]{40}",
}
TEST_SSNS = ("078051120", "219099999")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CONTEXT, BOOST, SUPPRESS, LIMIT = 100, 0.15, 0.2, 0.4
BY_NAME = {p.name: p for p in PATTERNS}


def needs(pattern: Pattern) -> str:
    """A cheap pattern that every line with a match matches."""
    return NEEDS[pattern.name] if pattern == BY_NAME.get(pattern.name) else ""


def java(regex: str) -> str:
    """Classes like \\w and \\b as in Python: Unicode-aware."""
    return f"(?U){regex}"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    d = digits(value)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def _mod97(value: Column) -> Column:
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), F.lit(0), step)


def iban_valid(value: Column) -> Column:
    v = F.upper(F.regexp_replace(value, "[ -]", ""))
    return (F.length(v) >= 15) & v.rlike("^[A-Z0-9]+$") & (_mod97(F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4))) == 1)


def de_tax_id_valid(value: Column) -> Column:
    d = digits(value)
    each = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.length(d) - F.length(F.replace(d, k.cast("string"), F.lit(""))))
    return (F.length(d) == 11) & (F.substring(d, 1, 1) != "0") & (F.array_max(each) <= 3) & (F.array_min(each) == 0)


def es_dni_valid(value: Column) -> Column:
    number = F.try_to_number(F.substring(value, 1, 8), F.lit("99999999")).cast("int")
    return value.rlike("^[0-9]{8}[A-Z]$") & (F.substring(value, 9, 1) == F.substr(F.lit(DNI_LETTERS), number % 23 + 1, F.lit(1)))


def accepted(pattern: Pattern, match: Column) -> Column:
    """The check that a built-in pattern's matches must pass."""
    if pattern != BY_NAME.get(pattern.name):
        return F.lit(True)
    checks = {"credit_card": luhn_valid, "iban": iban_valid, "de_tax_id": de_tax_id_valid, "es_dni": es_dni_valid, "ssn": lambda m: ~digits(m).isin(*TEST_SSNS)}
    return checks.get(pattern.name, lambda _: F.lit(True))(match)


def matches_of(pattern: Pattern, line: Column) -> Column:
    """Accepted matches of one pattern, as an array."""
    found = F.regexp_extract_all(line, F.lit(java(pattern.regex)), F.lit(0))
    return F.filter(found, lambda m: accepted(pattern, m))


def patterns_with(custom: tuple[tuple[str, str], ...] = ()) -> list[Pattern]:
    return [*PATTERNS, *[Pattern(n, n, r) for n, r in custom]]


def found_in(text: Column, patterns: list[Pattern] | None = None) -> Column:
    """Array of (pattern, n) of the patterns with a match in a text, each line by itself, as a pattern may not run over its end."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def total(p: Pattern) -> Column:
        some = F.filter(lines, lambda x: x.rlike(needs(p)))
        return F.aggregate(some, F.lit(0), lambda n, x: n + F.size(matches_of(p, x))).cast("long")

    per = [F.struct(F.lit(p.name).alias("pattern"), total(p).alias("n")) for p in patterns or PATTERNS]
    return F.filter(F.array(*per), lambda e: e["n"] > 0)


def count_matches(corpus: DataFrame, patterns: list[Pattern] | None = None) -> DataFrame:
    """id, pattern, n of texts and patterns with a match; nothing is shuffled, the counts of a text are made in its row."""
    return corpus.select("id", F.inline(found_in(F.col("text"), patterns)).alias("pattern", "n"))


def matches(corpus: DataFrame, patterns: list[Pattern] | None = None) -> DataFrame:
    """id, pattern, line_no (from 1), start, matched, line: every accepted match with its place in its line."""
    use = patterns or PATTERNS
    lines = corpus.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    out = None
    for p in use:
        regex = java(p.regex)
        between = F.split("line", regex)
        found = F.regexp_extract_all("line", F.lit(regex), F.lit(0))
        some = lines.where(F.col("line").rlike(needs(p)) & F.col("line").rlike(regex)).select("id", "line_no", "line", F.posexplode(found).alias("k", "matched"), between.alias("__b"), found.alias("__f"))
        length = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
        start = length(F.slice("__b", F.lit(1), F.col("k") + 1)) + length(F.slice("__f", F.lit(1), F.col("k")))
        some = some.where(accepted(p, F.col("matched"))).select("id", F.lit(p.name).alias("pattern"), (F.col("line_no") + 1).alias("line_no"), start.alias("start"), "matched", "line")
        out = some if out is None else out.unionByName(some)
    return out


def confidence(pattern: Pattern, line: Column, start: Column, matched: Column) -> Column:
    """How sure a match is: base, plus words nearby that speak for it, less those that speak against.

    A word counts at its first place on either side, by its nearness; each
    sum is at most ``LIMIT``.
    """
    size = F.length(matched)
    before = F.lower(F.substr(line, F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT))))
    after = F.lower(F.substr(line, start + size + 1, F.lit(CONTEXT)))
    around = F.concat(before, F.lit(" "), after)
    middle = F.length(before)

    def total(words: tuple[str, ...], step: float) -> Column:
        if not words:
            return F.lit(0.0)

        def add(so_far: Column, word: Column) -> Column:
            at = F.regexp_instr(around, F.concat(F.lit("(?U)\\b\\Q"), word, F.lit("\\E\\b")))
            near = F.greatest(F.lit(0.2), 1 - F.abs(at - 1 - middle) / float(CONTEXT))
            return so_far + F.when(at > 0, step * near).otherwise(0.0)

        return F.least(F.aggregate(F.array(*[F.lit(w) for w in words]), F.lit(0.0), add), F.lit(LIMIT))

    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(pattern.base) + total(pattern.boost, BOOST) - total(pattern.suppress, SUPPRESS)))


def scored_matches(corpus: DataFrame, min_confidence: float = 0.0, patterns: list[Pattern] | None = None) -> DataFrame:
    """``matches`` with confidence, at least ``min_confidence``; without the line."""
    out = None
    for p in patterns or PATTERNS:
        some = matches(corpus, [p]).withColumn("confidence", confidence(p, F.col("line"), F.col("start"), F.col("matched")))
        out = some if out is None else out.unionByName(some)
    return out.where(F.col("confidence") >= min_confidence).drop("line")


def file_rollup(counts: DataFrame) -> DataFrame:
    """id, n_matches, pii_types (sorted, comma-joined)."""
    return counts.groupBy("id").agg(F.sum("n").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias("pii_types"))


def type_rollup(counts: DataFrame) -> DataFrame:
    """pattern, n_matches, n_files."""
    return counts.groupBy("pattern").agg(F.sum("n").cast("long").alias("n_matches"), F.count(F.lit(1)).alias("n_files"))


def samples(scored: DataFrame, per_file: int = 5) -> DataFrame:
    """id, samples: the first matches of each text. Matched text leaves only through here."""
    one = F.struct("line_no", "start", "pattern", "matched", "confidence")
    return scored.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(one)), 1, per_file).alias("samples"))
