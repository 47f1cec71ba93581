"""Fields of bills in their text: numbers, dates, amounts, parties and project lines; keys, classes and scores of mail."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from .numeric import let, normalize_amount
from .text import STRONG_SUFFIXES, cut_suffix, first_subject

# Labels of amounts and dates, in order.
TOTAL_LABELS = ["summa kokku", "arve kokku", "kokku tasuda", "tasuda", "tasumisele kuulub", "kokku", "total", "grand total", "payable"]
VAT_LABELS = ["käibemaks", "kaibemaks", "käibemaksu summa", "kaibemaksu summa", "km summa", "km (24%)", "km(24%)", "km 24%", "km 22%", "km 20%", "vat"]
DATE_LABELS = ["arve kuupäev", "arve kuupaev", "kuupäev", "kuupaev", "invoice date", "date"]
DUE_LABELS = ["maksetähtaeg", "maksetahtaeg", "tasumise tähtaeg", "tasumise tahtaeg", "tähtaeg", "tahtaeg", "due date"]
WITHOUT_VAT = r"käibemaksuta|kaibemaksuta|ilma\s+km|km-ta|without\s+vat|without\s+tax"
AMOUNT = r"(\d[\d .\x{A0}]*[,.]\d{2})"
DATE = r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})"
# Patterns of a bill's number, in order; words that are no number; words of reminders.
NUMBER_PATTERNS = [
    r"\barve[-\s]*saateleht\s*nr\.?\s*:?\s*([A-Z0-9._/-]+)",
    r"\barve[-\s]*saateleht\s*:?\s*([A-Z0-9._/-]+)",
    r"\barve\s*nr\.?\s*:?\s*([A-ZÕÄÖÜ0-9._/-]+)",
    r"\barvenr\.?\s*:?\s*([A-ZÕÄÖÜ0-9._/-]+)",
    r"\barve\s+([A-Z0-9._/-]*\d[A-Z0-9._/-]*)",
    r"\binvoice\s*(?:no|nr|number)\.?\s*:?\s*([A-Z0-9._/-]+)",
]
SERIES = r"(?i)\binvoice\s+series\s*:?\s*([A-Z0-9._/-]+)\s+no\.?\s*:?\s*([A-Z0-9._/-]+)"
LABELLED = [r"\barve\s*(?:nr\.?|number|#|:)?\s*([a-z0-9][a-z0-9./-]{2,})", r"\binvoice\s*(?:no\.?|number|#|:)?\s*([a-z0-9][a-z0-9./-]{2,})"]
GENERIC = r"\b([a-z]{0,6}\d[a-z0-9./-]{3,})\b"
NO_NUMBER = ["vaatamine", "tasumine", "tasumata", "eest", "nr", "number"]
REMINDERS = ["meeldetuletus", "maksemeenutus", "märgukiri", "margukiri", "tasumata", "võlateatis", "volateatis", "üle maksetähtaja", "ule maksetahtaja"]
# Words that a mail is scored by.
INVOICE_WORDS = ["arve", "invoice", "faktuur", "bill", "rechnung", "ostuarve", "müügiarve", "muugiarve", "käibemaks", "kaibemaks", "km"]
RECEIPT_WORDS = ["receipt", "kviitung", "tsekk", "tšekk", "payment", "makse"]
NEGATIVE_WORDS = ["newsletter", "uudiskiri", "reklaam", "campaign"]
IMAGE_SUFFIXES, IMAGE_WORDS = ["jpg", "jpeg", "png"], ["arve", "invoice", "receipt", "tsekk"]
MAIL_NUMBER = r"\b(arve|invoice|nr|no\.?)\s*[:#-]?\s*[a-z0-9][a-z0-9./-]{2,}"
MAIL_AMOUNT = r"(?U)\b\d+[,.]\d{2}\s*(eur|€)(?![\p{L}\d_])"
# Registry code and tax number behind their labels, what ends a party's name, its legal forms, and lines that
# are no name.
REGISTRY = r"(?iU)\b(?:registrikood|reg\.?\s*kood|reg\.?\s*nr\.?|reg\.?\s*no\.?|registreerimisnr\.?|registreerimis\s*nr\.?)\s*:?\s*([A-Z0-9-]{6,15})\b"
TAX = r"(?iU)\b(?:kmkr|kmkr\s*nr|käibemaksukohustuslase\s*nr|kaibemaksukohustuslase\s*nr|vat\s*no\.?)\s*:?\s*([A-Z]{2}[A-Z0-9]{8,14})\b"
NAME_ENDS = r"(?iU)\b(?:tel|telefon|phone|faks|fax|pank|bank|swift|iban|vat\s*no\.?|kmkr|reg\.?\s*nr\.?|registrikood|registreerimisnr\.?)\b"
NAME_AND_CODE = r"(?iU)^\s*(.+?)\s+(?:registrikood|reg\.?\s*kood|reg\s*nr|reg\.?\s*no\.?|registreerimisnr\.?|registreerimis\s*nr\.?)\s*:?\s*[A-Z0-9-]{6,15}\b"
FORM = r"(?iU)\b(AB|AS|OÜ|OU|UAB|SIA|GmbH|Ltd|LLC)\b"
NO_NAME = r"(?iU)@|\+\d|^\d|tn\b|linn\b|tallinn|kuupäev|kuupaev"
FIRST_COMPANY = r"(?iU)\b(.+?\b(?:OÜ|OU|AS|MTÜ|SA|FIE))\b"
CONTACT_MARKS = [" Tel", " tel", " E-post", " e-post", " Email", " email", " info@", " www."]


def has_any(c, words):
    return reduce(or_, (c.contains(w) for w in words))


def compact(c):
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[ \t]+", " ")


def lines(c):
    return F.split(c, r"\r\n|\n|\r")


def trimmed(c):
    """The lines of a text without blanks at their ends."""
    return F.transform(lines(c), lambda x: F.trim(x))


def last_of(c, pattern, group: int = 1):
    return F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), group), F.lit(-1)), F.lit(""))


def labelled_amount(text, labels: list[str], vat: bool = False):
    """The last amount on the first line that holds a label and an amount; else the last one close behind a label."""
    fits = lambda x: let(F.lower(x), lambda low: has_any(low, labels) & (~low.rlike(WITHOUT_VAT) if vat else F.lit(True))) & x.rlike(AMOUNT)
    line = F.get(F.filter(lines(text), fits), 0)
    near = last_of(text, rf"(?i)(?:{'|'.join(map(re.escape, labels))})[^\d]{{0,60}}{AMOUNT}")
    return normalize_amount(let(line, lambda x: F.when(x.isNotNull(), last_of(x, AMOUNT)).otherwise(near)))


def gross_amount(text, total, vat):
    """total plus vat where the text holds that amount too, else total."""
    cents = lambda x: normalize_amount(x).try_cast("double")

    def of(x):
        t, v = x["total"].try_cast("double"), x["vat"].try_cast("double")
        return F.struct(x["total"].alias("total"), v.alias("vat"), F.bround(t + v, 2).alias("gross"))

    def pick(x):
        holds = F.exists(F.regexp_extract_all(text, F.lit(AMOUNT), 1), lambda y: F.coalesce(F.abs(cents(y) - x["gross"]) < 0.005, F.lit(False)))
        return F.when((x["vat"] > 0) & holds, F.format_string("%.2f", x["gross"])).otherwise(x["total"])

    return let(let(F.struct(total.alias("total"), vat.alias("vat")), of), pick)


def normal_date(c):
    """Year, month and day of d.m.y, with two or four digits of the year, or y.m.d, as yyyy-MM-dd."""

    def of(c, p):
        first = F.length(p[0]) == 4
        year = F.when(first, p[0]).when(F.length(p[2]) == 2, F.concat(F.lit("20"), p[2])).otherwise(p[2])
        day = F.when(first, p[2]).otherwise(p[0])
        return F.when(F.size(p) == 3, F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(p[1], 2, "0"), F.lpad(day, 2, "0"))).otherwise(c)

    return let(c, lambda c: let(F.split(F.translate(F.trim(c), "./", "--"), "-"), lambda p: of(c, p)))


def labelled_date(text, labels: list[str]):
    found = F.regexp_extract(text, rf"(?i)(?:{'|'.join(map(re.escape, labels))})[^\d]{{0,40}}{DATE}", 1)
    return let(found, lambda x: F.when(x != "", normal_date(x)).otherwise(""))


def date_near_number(text):
    """The last date on the first line that names a bill and holds one, else a line that is one within three below such a line."""
    head = lambda x: x.rlike(r"(?i)\b(arve|invoice)\b")

    def of(all_):
        same = F.get(F.filter(all_, lambda x: head(x) & x.rlike(DATE)), 0)
        below = F.transform(all_, lambda x, i: F.when(head(x), F.get(F.filter(F.slice(all_, i + 2, F.lit(3)), lambda y: y.rlike(rf"^{DATE}$")), 0)))
        other = F.get(F.filter(below, lambda x: x.isNotNull()), 0)
        return let(same, lambda x: F.when(x.isNotNull(), normal_date(last_of(x, DATE))).otherwise(F.coalesce(normal_date(other), F.lit(""))))

    return let(trimmed(text), of)


def bill_number(text):
    """Series and number, else the first of six patterns that is found."""
    series = F.concat(F.regexp_extract(text, SERIES, 1), F.regexp_extract(text, SERIES, 2))
    out = [F.nullif(c, F.lit("")) for c in (series, *(F.regexp_extract(text, "(?i)" + p, 1) for p in NUMBER_PATTERNS))]
    return F.btrim(F.coalesce(*out, F.lit("")), F.lit(" .:-"))


def number_from_name(name, text):
    """The first run of 5 to 12 digits of a file's name that the text holds too, white space aside."""
    plain = F.lower(F.regexp_replace(text, r"\s+", ""))
    runs = F.regexp_extract_all(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(r"(\d{5,12})"), 1)
    return F.coalesce(F.get(F.filter(runs, lambda x: plain.contains(x)), 0), F.lit(""))


def clean_name(c):
    return F.btrim(F.regexp_replace(F.get(F.split(c, NAME_ENDS, 2), 0), r"\s+", " "), F.lit(" :-"))


def issuer_name(text, own: str):
    """A party's name by layout: below a line of seller and buyer, before a registry code on its line, or within eight lines
    above one; names that hold `own`, letters and digits alone, are the reader's own company."""
    is_own = lambda x: F.regexp_replace(F.lower(x), "[^0-9a-z]+", "").contains(own)
    company = lambda x: F.trim(F.regexp_extract(clean_name(x), r"(?iU)^(.+?\b(?:AB|AS|OÜ|OU|UAB|SIA|GmbH|Ltd|LLC))\b", 1))
    first = lambda xs: F.get(F.filter(xs, lambda x: F.coalesce(x, F.lit("")) != ""), 0)
    under = lambda all_: F.flatten(F.transform(all_, lambda x, i: F.when(x.rlike(r"(?i)\bseller\b.*\bbuyer\b"), F.transform(F.slice(all_, i + 2, F.lit(4)), company)).otherwise(F.array().cast("array<string>"))))
    named = lambda x: F.when(x.rlike(NAME_AND_CODE), clean_name(F.regexp_extract(x, NAME_AND_CODE, 1)))
    good = lambda x: (x != "") & ~is_own(x) & ~x.rlike(NO_NAME) & x.rlike(FORM)

    def at(all_, x, i):
        inline = let(named(x), lambda n: F.when(F.coalesce((n != "") & ~is_own(n), F.lit(False)), n))
        above = F.transform(F.reverse(F.slice(all_, F.greatest(i - 7, F.lit(1)), F.least(i, F.lit(8)))), clean_name)
        return F.coalesce(inline, F.when(x.rlike(REGISTRY), F.get(F.filter(above, good), 0)))

    return let(trimmed(text), lambda all_: F.coalesce(first(under(all_)), first(F.transform(all_, lambda x, i: at(all_, x, i))), F.lit("")))


def _window(all_, name, size: int, pattern: str):
    """What a pattern finds in the first window of lines, from one that holds the name, in which it is found."""
    spots = F.transform(all_, lambda x, i: F.when(F.lower(x).contains(F.lower(name)), F.regexp_extract(F.array_join(F.slice(all_, i + 1, F.lit(size)), "\n"), pattern, 1)))
    return F.when(name != "", F.get(F.filter(spots, lambda x: F.coalesce(x, F.lit("")) != ""), 0))


def tax_number(text, name):
    spot = let(trimmed(text), lambda all_: let(name, lambda n: _window(all_, n, 8, TAX)))
    return F.upper(F.coalesce(spot, last_of(text, TAX)))


def registry_code(text, name, own: str):
    is_own = lambda x: F.regexp_replace(F.lower(x), "[^0-9a-z]+", "").contains(own)

    def of(all_):
        other = F.get(F.filter(all_, lambda x: x.rlike(REGISTRY) & ~is_own(x)), 0)
        return F.coalesce(let(name, lambda n: _window(all_, n, 6, REGISTRY)), F.regexp_extract(other, REGISTRY, 1), F.lit(""))

    return let(trimmed(text), of)


def account_number(text):
    """The first account of valid length on a line that says IBAN, else anywhere."""
    from .text import valid_iban

    # an account may be written in groups; word ends keep what follows apart
    found = lambda c: F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b([A-Z]{2}\d{2}[A-Z0-9 ]{10,34})\b"), 1), lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")), valid_iban)
    tail = lambda x: F.get(F.split(F.get(F.split(x, r"(?i)\biban\b\s*:?", 2), 1), r"(?i)\b(phone|tel|telefon|email|e-mail|vat|kmkr|reg|swift|bic)\b", 2), 0)
    marked = F.flatten(F.transform(F.filter(lines(text), lambda x: x.rlike(r"(?i)\biban\b")), lambda x: found(tail(x))))
    return F.coalesce(F.get(marked, 0), F.get(found(text), 0), F.lit(""))


def extract(text, own: str):
    """All fields of a bill's text as a struct."""

    def of(t, name, vat):
        return F.struct(
            name.alias("issuer_name"),
            bill_number(t).alias("invoice_number"),
            gross_amount(t, labelled_amount(t, TOTAL_LABELS), vat).alias("amount_total"),
            vat.alias("vat_amount"),
            account_number(t).alias("payment_details"),
            labelled_date(t, DUE_LABELS).alias("due_date"),
            let(labelled_date(t, DATE_LABELS), lambda day: F.when(day != "", day).otherwise(date_near_number(t))).alias("invoice_date"),
            registry_code(t, name, own).alias("issuer_reg_code"),
            tax_number(t, name).alias("issuer_vat_no"),
        )

    return let(compact(text), lambda t: let(issuer_name(t, own), lambda name: let(labelled_amount(t, VAT_LABELS, vat=True), lambda vat: of(t, name, vat))))


def merge(first, second, names: list[str]):
    """The first non-empty value of each field."""
    pick = lambda k: F.coalesce(F.nullif(first[k], F.lit("")), second[k]).alias(k)
    return F.struct(*(pick(k) for k in names))


def first_company(c):
    """A text up to its first legal form, else up to contact details, at most 150 signs."""
    c = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    found = F.regexp_extract(c, FIRST_COMPANY, 1)
    cut = c
    for m in CONTACT_MARKS:
        cut = F.trim(F.get(F.split(cut, re.escape(m), 2), 0))
    return F.btrim(F.when(found != "", found).otherwise(F.substring(cut, 1, 150)), F.lit(" ,.;:-"))


def project_lines(text):
    """Array of (code, name, description, quantity, price, net): rows that start with AKT and run to a line that ends in an
    amount; where there are none, lines that refer to a project, the first of each code."""
    number = lambda x: F.coalesce(F.regexp_replace(F.regexp_replace(x, "[  ]", ""), ",", ".").try_cast("decimal(20,3)"), F.lit(0).cast("decimal(20,3)"))
    flat = F.array_join(F.filter(F.transform(lines(F.coalesce(text, F.lit(""))), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""), "\n")
    runs = F.regexp_extract_all(flat, F.lit(r"(?m)^(AKT(?:(?!\nAKT)[\s\S])*?\d[\d\s\x{A0}]*,\d{2})$"), 1)
    end, code = r"(\d[\d\s\x{A0}]*,\d{2})\s*$", r"\b((?:25|26)\d{3})\b"

    def row(x):
        x = F.regexp_replace(x, r"\s+", " ")
        net = F.regexp_extract(x, end, 1)
        head = F.left(x, F.length(x) - F.length(net))
        tail = F.substr(x, F.greatest(F.length(head) - 29, F.lit(1)))
        numbers = F.regexp_extract_all(tail, F.lit(r"(\d+(?:,\d{1,3})?)"), 1)
        three = F.size(numbers) >= 3
        at = lambda k: F.when(three, number(F.try_element_at(numbers, F.lit(k))))
        own = F.regexp_extract(x, code, 1)
        inside = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r"\((.*?)\)", 1), code, ""), r"^\d{5}\s*-\s*", ""), r"\s+", " ")
        name = F.btrim(F.regexp_replace(F.regexp_replace(F.get(F.split(inside, "/", 2), 0), r"\b[2-9]\d{4}\b", ""), r"\s+", " "), F.lit(" -/"))
        description = F.trim(F.regexp_replace(F.trim(head), r"\s+\d+(?:,\d{1,3})?\s+\d[\d\s\x{A0}]*(?:,\d{0,2})?\s*$", ""))
        return F.struct(own.alias("code"), F.when(name != "", name).otherwise(own).alias("name"), description.alias("description"), F.coalesce(at(-3), F.lit(1).cast("decimal(20,3)")).alias("quantity"), F.coalesce(at(-2), F.lit(0).cast("decimal(20,3)")).alias("price"), number(net).alias("net"))

    whole = F.transform(F.filter(runs, lambda x: x.contains("(") & x.rlike(code)), row)
    mark, reference = r"(?i)objekti\s+viide|projekt|project", r"(?i)\b((?:25|26)\d{3})\s*(?:[-–—]\s*([^,;|()\n\r]+))?"
    zero = F.lit(0).cast("decimal(20,3)")

    def refer(x):
        own = F.regexp_extract(x, reference, 1)
        name = F.regexp_replace(F.btrim(F.regexp_extract(x, reference, 2), F.lit(" -")), r"(?i)\s+Lk\s+\d+\s*/\s*\d+\s*$", "")
        return F.struct(own.alias("code"), F.when(name != "", name).otherwise(own).alias("name"), F.trim(F.concat_ws(" ", own, name)).alias("description"), F.lit(1).cast("decimal(20,3)").alias("quantity"), zero.alias("price"), zero.alias("net"))

    refers = F.transform(F.filter(F.split(flat, "\n"), lambda x: x.rlike(mark) & (F.regexp_extract(x, reference, 1) != "")), refer)
    firsts = F.filter(refers, lambda x, i: F.array_position(F.transform(refers, lambda y: y["code"]), x["code"]) == i + 1)
    return F.when(F.size(whole) > 0, whole).otherwise(firsts)


def mail_numbers(c):
    """Sorted distinct numbers of a text: labelled ones and any token with a digit, without file suffixes and stop words."""
    low = F.lower(c)
    found = F.concat(*(F.regexp_extract_all(low, F.lit(p), 1) for p in [*LABELLED, GENERIC]))
    bare = F.transform(found, lambda x: F.btrim(x, F.lit(" ._-")))
    for s in (".pdf", ".xml", ".xlsx", ".xls", ".csv"):
        bare = F.transform(bare, cut_suffix(s))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: x.rlike("[0-9]") & ~x.isin(NO_NUMBER))))


def _named(c, suffixes):
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(parts, lambda x: F.lower(x).rlike(rf"\.(?:{'|'.join(suffixes)})$"))


def mail_key(sender, subject, attachments):
    """att: and the names of strong attachments, else num: with sender and numbers, else sub: with sender and subject."""
    names = F.array_sort(F.transform(_named(attachments, STRONG_SUFFIXES), first_subject))
    numbers = mail_numbers(F.concat_ws(" ", F.coalesce(sender, F.lit("")), F.coalesce(subject, F.lit(""))))
    who = first_subject(sender)
    return (
        F.when(F.size(names) > 0, F.concat(F.lit("att:"), F.array_join(names, "|")))
        .when(F.size(numbers) > 0, F.concat(F.lit("num:"), who, F.lit("|"), F.array_join(numbers, "|")))
        .otherwise(F.concat(F.lit("sub:"), who, F.lit("|"), first_subject(subject)))
    )


def mail_class(subject, reasons, attachments, score):
    """(class, score): a reminder, a likely or possible bill, or one that needs a look."""
    text = first_subject(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(reasons, F.lit("")), F.coalesce(attachments, F.lit(""))))
    strong = F.size(_named(attachments, STRONG_SUFFIXES)) > 0
    numbers = F.size(mail_numbers(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(attachments, F.lit(""))))) > 0
    both = F.coalesce(reasons, F.lit("")).contains("invoice keywords") & F.coalesce(reasons, F.lit("")).contains("possible invoice number")
    of = lambda name, n: F.struct(F.lit(name).alias("class"), F.greatest(F.lit(0), F.least(F.lit(100), n)).alias("score"))
    return (
        F.when(has_any(text, REMINDERS), of("reminder_or_debt_notice", score - 20))
        .when(strong & numbers, of("likely_invoice", score + 15))
        .when(strong, of("possible_invoice", score + 5))
        .when(both, of("possible_invoice", score))
        .otherwise(of("needs_review", score - 10))
    )


def mail_score(parts, attachments):
    """(score, reasons): 0 to 100 by words, attachments, number and amount; parts are the mail's texts."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts), F.regexp_replace(F.coalesce(attachments, F.lit("")), ";", " ")))
    hits = lambda words: sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    images = F.filter(_named(attachments, IMAGE_SUFFIXES), lambda x: has_any(F.lower(x), IMAGE_WORDS))
    i, r, n = hits(INVOICE_WORDS), hits(RECEIPT_WORDS), hits(NEGATIVE_WORDS)
    rules = [
        ("invoice keywords", i > 0, F.least(F.lit(45), 18 + i * 7)),
        ("receipt/payment keywords", r > 0, F.least(F.lit(25), 10 + r * 5)),
        ("invoice-like attachments", F.size(_named(attachments, STRONG_SUFFIXES)) > 0, F.lit(25)),
        ("named image attachments", F.size(images) > 0, F.lit(15)),
        ("possible invoice number", text.rlike(MAIL_NUMBER), F.lit(15)),
        ("possible euro amount", text.rlike(MAIL_AMOUNT), F.lit(10)),
        ("negative keywords", n > 0, F.lit(-25)),
    ]
    total = sum((F.when(c, x).otherwise(0) for _, c, x in rules), F.lit(0))
    return F.struct(F.greatest(F.lit(0), F.least(F.lit(100), total)).alias("score"), F.concat_ws("; ", *(F.when(c, name) for name, c, _ in rules)).alias("reasons"))
