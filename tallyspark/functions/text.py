"""Text: subjects, references, keys, bands and marks in messages."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from .numeric import let

# Legal forms that say nothing about a company, as words of a-z and digits, and suffixes of attachments
# that count.
COMPANY_STOP = ["aktsiaselts", "as", "fie", "mtu", "osauehing", "osauhing", "ou", "oy", "sa"]
STRONG_SUFFIXES = ["pdf", "xml", "asice", "bdoc", "ddoc", "xlsx", "xls", "csv"]
# Lengths of account numbers by country.
IBAN_LENGTHS = {"EE": 20, "SE": 24, "LV": 21, "LT": 20, "FI": 18, "DE": 22, "NO": 15, "DK": 18, "PL": 28, "NL": 18}
# Lines that open a signature, starts of quoted header lines, and words that tell a language.
SIGNATURES = ["best regards", "regards", "lugupidamisega"]
HEADERS = ["from:", "sent:", "subject:", "-----original message"]
ESTONIAN, ENGLISH = [" kas ", "palun", "kinnitage", "homme", "kuupäev"], ["please", "confirm", "tomorrow", "approved"]


def clean_subject(c):
    """Lower case without leading re: / fw: / fwd:, repeated ones too, spaces collapsed."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"^((re|fw|fwd)\s*:\s*)+", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_tags(c):
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))


def lookup_key(c):
    return F.regexp_replace(F.lower(c), "[^0-9a-zõäöü]+", "")


def first_subject(c):
    """Lower case without one leading re: / fw: / fwd:, spaces collapsed."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"^(re|fw|fwd)\s*:\s*", ""), r"\s+", " ")


def cut_suffix(suffix: str):
    return lambda x: F.when(x.endswith(suffix), F.left(x, F.length(x) - len(suffix))).otherwise(x)


def reference_tokens(c, suffixes=(".pdf", ".xml")):
    """Sorted distinct words of at most 8 letters, a digit and two or more further signs, file suffixes cut off."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"\b([a-z]{0,8}[0-9][a-z0-9./-]{2,})\b"), 1)
    bare = F.transform(found, lambda x: F.btrim(x, F.lit(" ._-")))
    for s in suffixes:
        bare = F.transform(bare, cut_suffix(s))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: x.rlike("[0-9]"))))


def strong_attachments(c):
    """Names, split at ;, with a suffix that counts."""
    parts = F.transform(F.split(c, ";"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.lower(x).rlike(r"\.(" + "|".join(STRONG_SUFFIXES) + r")$"))


def remittance_number(c):
    """The number that a remittance text names behind arve or invoice, or an empty text."""
    c, out = F.coalesce(c, F.lit("")), F.lit("")
    for word in ("invoice", "arve"):
        found = F.btrim(F.regexp_extract(c, rf"(?i)\b{word}\s*(?:nr|number|no)?\.?\s*:?\s*([A-Z0-9._/-]{{2,}})", 1), F.lit(" .:-/"))
        out = F.when(found != "", found).otherwise(out)
    return out


def company_tokens(c):
    """Sorted distinct runs of a-z and digits, two or more signs long, without legal forms."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([0-9a-z]+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(COMPANY_STOP))))


def companies_match(a, b):
    """One token set holds the other, or they share two (or all of the smaller)."""
    common = F.size(F.array_intersect(a, b))
    least = F.least(F.lit(2), F.size(a), F.size(b))
    return F.coalesce((least > 0) & (common >= least), F.lit(False))


def confidence_band(c, other: str = "low"):
    return F.when(c >= 95, "exact").when(c >= 80, "high").when(c >= 60, "medium").otherwise(other)


def holds_code(text, code: str):
    """The code stands by itself: no letter or digit on either side."""
    return text.rlike(rf"(?i)(?<![A-Za-z0-9]){re.escape(code)}(?![A-Za-z0-9])")


def code_tokens(c):
    """The runs of letters and digits of a text, in lower case: a code that stands by itself is one of them."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != ""))


def _any(c, marks):
    return reduce(or_, (c.contains(m) for m in marks))


def guess_language(subject, body):
    low = F.lower(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))))
    return F.when(_any(low, ESTONIAN), "et").when(_any(low, ENGLISH), "en").otherwise("unknown")


def clean_body(c, most: int | None = None):
    """Lines without quotes, header lines and blanks up to a signature; the whole body unless `most` characters are asked for."""
    sign, head = max(map(len, SIGNATURES)), max(map(len, HEADERS))  # lower case has never fewer letters
    signature = lambda x: F.when(F.length(x) <= sign, F.lower(x).isin(SIGNATURES)).otherwise(False)
    header = lambda x: F.exists(F.array(F.lower(F.left(x, F.lit(head)))), lambda y: reduce(or_, (y.startswith(h) for h in HEADERS)))
    until = lambda lines, end: F.when(end > 0, F.slice(lines, F.lit(1), (end - 1).cast("int"))).otherwise(lines)
    body = let(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda lines: let(F.array_position(F.transform(lines, signature), F.lit(True)), lambda end: until(lines, end)))
    text = F.array_join(F.filter(body, lambda x: (x != "") & ~x.startswith(">") & ~header(x)), "\n")
    return text if most is None else F.substring(text, 1, most)


def running_sums(n, block: int = 32):
    """Sums of what stands before each of an array's whole numbers: within blocks and over blocks, for an array that grows by
    one is copied each time."""
    sums = lambda n, first: F.aggregate(n, F.array(first).cast("array<int>"), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    cut = lambda n: F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / block).cast("int")), lambda k: F.slice(n, k * block + 1, F.lit(block)))
    total = lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)
    inner = lambda b, first: F.slice(sums(b, first), F.lit(1), F.size(b))
    return let(let(n, cut), lambda bs: let(sums(F.transform(bs, total), F.lit(0)), lambda firsts: F.flatten(F.transform(bs, lambda b, k: inner(b, F.get(firsts, k))))))


def sentences(c):
    """Array of (text, start, end): runs between . ? ! and line ends, the mark included; 0-based, end open."""
    parts = F.regexp_extract_all(c, F.lit(r"([^.?!\n]+[.?!\n]?|[.?!\n])"), 1)
    row = lambda x, at: F.struct(F.btrim(x, F.lit(" \t\n\x0b\f\r")).alias("text"), at.alias("start"), (at + F.length(x)).alias("end"))
    run = let(parts, lambda p: let(running_sums(F.transform(p, F.length)), lambda at: F.transform(p, lambda x, i: row(x, F.get(at, i)))))
    return F.filter(run, lambda s: s["text"] != "")


def valid_iban(c):
    """The right length for its country, or 15 to 34 signs where the country is not listed."""
    packed = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    table = F.create_map(*(F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv))
    fit = F.try_element_at(table, F.substring(packed, 1, 2))
    return F.when(fit.isNotNull(), F.length(packed) == fit).otherwise(F.length(packed).between(15, 34))


def find_ibans(c):
    """Sorted distinct account numbers in a text."""
    packed = F.regexp_extract_all(F.upper(F.regexp_replace(c, " ", "")), F.lit(r"([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})"), 1)
    return F.array_sort(F.array_distinct(F.filter(packed, valid_iban)))
