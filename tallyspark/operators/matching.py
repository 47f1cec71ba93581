"""Matching of bank rows, bills, ledger rows and mail by explainable scores, and keep-best dedup.

A pair's score sums its evidence: equal amounts, the number or a token of a reference, an equal account, a party. All of it
is put as equal keys: cents, tokens, accounts, and for a party the texts that one name holds of the other side's names.
What can reach the threshold holds an amount, a token or an account. A value of these that at most LIGHT right rows have
is joined as it is. A value that more have is hot and never joined alone with all of them: rows get a key for every set of
their hot values, with and without a party's, that is worth the threshold, and of the right rows of such a set only the
first in tie order is a candidate. The best right row of a left row is the first of the set of all its evidence, so no best
pair is lost; a left row meets at most LIGHT right rows for each of its values and one for each of its sets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import companies_match, company_tokens, reference_tokens
from ..sources.shared import spread, written


@dataclass(frozen=True)
class Weights:
    """What each piece of evidence counts; company: a party matches by the words of a company's name too."""

    amount: int
    number: int
    token: int
    party: int
    account: int = 0
    company: bool = False
    number_of: str = "right"  # the side whose number is looked for among the other's tokens


#: Right rows that a key may have and still be joined alone: a left row meets up to so many for each of its values, so the
#: limit is what pairs can grow to.
LIGHT = 8
BANK_BILL = Weights(50, 45, 35, 20, account=35)
LEDGER_BANK = Weights(50, 45, 35, 30, company=True, number_of="left")
LEDGER_MAIL = Weights(45, 50, 35, 20, number_of="left")


def side(rows: DataFrame, id_: str, amount: str, party: str, texts: list[str], number: str | None = None, account: str | None = None, kind=None, order: list[str] | None = None) -> DataFrame:
    """A side of a match: (id, kind, amount, party, number, account, tokens, tie)."""
    plain = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    text = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts))
    digits = F.nullif(F.regexp_replace(F.coalesce(F.col(account), F.lit("")), r"[^0-9]+", ""), F.lit("")) if account else F.lit(None).cast("string")
    return spread(rows).select(
        F.col(id_).alias("id"),
        (kind if kind is not None else F.lit("")).alias("kind"),
        F.col(amount).cast("decimal(20,2)").alias("amount"),
        plain(party).alias("party"),
        (plain(number) if number else F.lit(None).cast("string")).alias("number"),
        digits.alias("account"),
        reference_tokens(text).alias("tokens"),
        F.struct(*(F.col(c) for c in [*(order or []), id_])).alias("tie"),
    )


def _both(kind: str, c):
    return F.transform(c, lambda x: F.concat(F.lit(kind), x.cast("string")))


def held_names(names: DataFrame, others: DataFrame, shorter: bool = False) -> DataFrame:
    """(party, held): the others(party) that are parts of each of names(party), all distinct; shorter: only true parts. An empty
    text is no part.

    Parts are looked up among the others as whole texts, of the lengths these have: there are no more pairs than parts.
    """
    sizes = others.agg(F.collect_set(F.length("party")).alias("sizes"))
    parts = F.expr(f"""array_distinct(flatten(transform(filter(sizes, n -> n > 0 AND n {'<' if shorter else '<='} length(party)),
     n -> transform(sequence(1, length(party) - n + 1), i -> substr(party, i, n)))))""")
    found = names.crossJoin(sizes).select("party", F.explode(parts).alias("held"))
    return found.join(others.select(F.col("party").alias("held")), "held").select("party", "held")


def _company_keys(party: str, left: bool):
    """Keys of which two names share one if companies_match() says so: two of their words, or the word of a name of one."""
    words = company_tokens(F.col(party))
    two = F.flatten(F.transform(words, lambda x: F.transform(F.filter(words, lambda y: y > x), lambda y: F.concat_ws("+", F.lit("w"), x, y))))
    alone = F.when(F.size(words) == 1, words).otherwise(F.array().cast("array<string>"))
    mine, other = ("u", "v") if left else ("v", "u")
    return F.concat(two, _both(mine, alone), _both(other, words))


def with_party_keys(left: DataFrame, right: DataFrame, company: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides with `names`: keys of which two rows share one if the party of one holds the other's."""
    names = [rows.where("party is not null").select("party").distinct() for rows in (left, right)]
    in_right, in_left = held_names(names[1], names[0]), held_names(names[0], names[1], shorter=True)
    out = []
    # a right row has the left names within its own, a left row its own name, and the other way round
    for rows, within, own, mine, other in ((left, in_left, in_right, "l", "r"), (right, in_right, in_left, "r", "l")):
        held = within.groupBy("party").agg(F.collect_set("held").alias("held"))
        known = own.select(F.col("held").alias("party")).distinct().withColumn("known", F.lit(True))
        keyed = rows.join(held, "party", "left").join(known, "party", "left")
        none = F.array().cast("array<string>")
        keys = F.concat(_both(other, F.coalesce("held", none)), F.when(F.col("known"), F.array(F.concat(F.lit(mine), "party"))).otherwise(none))
        if company:
            keys = F.concat(keys, F.coalesce(_company_keys("party", mine == "l"), none))
        out.append(keyed.withColumn("names", F.array_distinct(keys)).drop("held", "known"))
    return out[0], out[1]


def _sets(rows: DataFrame, w: Weights, threshold: int) -> DataFrame:
    """rows with hot values (cents, accounts, references) and names -> a row for each set worth the threshold, `key`."""
    or_none = lambda c: F.explode(F.concat(c, F.array(F.lit("")))).alias
    rows = rows.select("kind", "id", "tie", or_none("cents")("c"), "accounts", "references", "names").select("*", or_none("accounts")("a")).select("*", or_none("references")("x"))
    worth = F.when(F.col("c") != "", w.amount).otherwise(0) + F.when(F.col("a") != "", w.account).otherwise(0) + F.when(F.col("x").startswith("n"), w.number).when(F.col("x") != "", w.token).otherwise(0)
    rows = rows.withColumn("worth", worth).where((F.col("worth") > 0) & (F.col("worth") + w.party >= threshold)).select("kind", "id", "tie", "c", "a", "x", "worth", or_none("names")("p"))
    rows = rows.where(F.col("worth") + F.when(F.col("p") != "", w.party).otherwise(0) >= threshold)
    return rows.select("kind", "id", "tie", F.concat_ws("&", "c", "a", "x", "p").alias("key"))


def keyed(rows: DataFrame, w: Weights, left: bool) -> DataFrame:
    """A side with its keys, written: the texts are read once. Amounts of the left side stand for three cents."""
    cents, spread, number = F.round(F.col("amount") * 100).cast("long"), int(left), F.array_compact(F.array("number"))
    numbered = w.number_of == ("left" if left else "right")
    rows = rows.withColumn("cents", _both("c", F.when(F.col("amount") != 0, F.sequence(cents - spread, cents + spread)).otherwise(F.array())))
    rows = rows.withColumn("accounts", _both("a", F.array_compact(F.array("account"))) if w.account else F.array().cast("array<string>"))
    rows = written(rows, "side")
    looked_for = F.array_distinct(F.concat("tokens", number)) if numbered else F.col("tokens")
    return rows.withColumn("numbers", number if numbered else F.col("tokens")).withColumn("keys", F.concat("cents", "accounts", _both("t", looked_for)))


def candidates(left: DataFrame, right: DataFrame, w: Weights, threshold: int = 50, light: int | None = None) -> DataFrame:
    """(l, r): ids of pairs of keyed rows among which the best of each left row that reaches the threshold is."""
    if threshold <= w.party:
        raise ValueError("a party alone may not reach the threshold")
    light = LIGHT if light is None else light
    one = lambda rows: rows.select("kind", F.explode("keys").alias("k"), "id")
    hot = written(one(right).groupBy("kind", "k").count().where(F.col("count") > light).select("kind", "k"), "hot-keys")
    alone = one(right).join(hot, ["kind", "k"], "left_anti").select("kind", "k", F.col("id").alias("r"))
    out = one(left).select("kind", "k", F.col("id").alias("l")).join(alone, ["kind", "k"]).select("l", "r")
    if hot.isEmpty():
        return out.distinct()

    def heated(rows: DataFrame) -> DataFrame:
        """Rows with hot values, and these by kind of evidence; a number counts apart from a token."""
        found = one(rows).join(hot, ["kind", "k"]).groupBy("id").agg(F.collect_set("k").alias("hot"))
        both = rows.join(found, "id")
        of = lambda c: F.array_intersect(c, F.col("hot"))
        renamed = F.transform(of(_both("t", F.col("numbers"))), lambda x: F.concat(F.lit("n"), F.substring(x, 2, 2**31 - 1)))
        return both.select("kind", "id", "tie", "party", of(F.col("cents")).alias("cents"), of(F.col("accounts")).alias("accounts"), F.concat(of(_both("t", F.col("tokens"))), renamed).alias("references"))

    hl, hr = with_party_keys(written(heated(left), "hot-left"), written(heated(right), "hot-right"), w.company)
    first = _sets(hr, w, threshold).groupBy("kind", "key").agg(F.min_by("id", "tie").alias("r"))
    sets = _sets(hl, w, threshold).select("kind", "key", F.col("id").alias("l")).join(first, ["kind", "key"])
    return out.unionByName(sets.select("l", "r")).distinct()


def score(pairs: DataFrame, w: Weights) -> DataFrame:
    """pairs with columns l_* and r_* of both sides -> score and reasons."""
    amount = F.coalesce((F.abs(F.col("l_amount") - F.col("r_amount")) <= F.lit(0.01).cast("decimal(20,2)")) & (F.col("r_amount") != 0) & (F.col("l_amount") != 0), F.lit(False))
    mine, other = ("r", "l") if w.number_of == "right" else ("l", "r")
    number = F.coalesce(F.array_contains(f"{other}_tokens", F.col(f"{mine}_number")), F.lit(False))
    token = ~number & F.arrays_overlap("l_tokens", "r_tokens")
    held = F.col("l_party").contains(F.col("r_party")) | F.col("r_party").contains(F.col("l_party"))
    if w.company:
        held = held | companies_match(company_tokens(F.col("l_party")), company_tokens(F.col("r_party")))
    party = F.coalesce(held, F.lit(False))
    account = F.coalesce(F.col("l_account") == F.col("r_account"), F.lit(False)) if w.account else F.lit(False)
    parts = [("amount", amount, w.amount), ("iban", account, w.account), ("invoice_number", number, w.number), ("token", token, w.token), ("party", party, w.party)]
    total = sum((F.when(c, n).otherwise(0) for _, c, n in parts), F.lit(0))
    return pairs.withColumn("score", total).withColumn("reasons", F.concat_ws("; ", *(F.when(c, name) for name, c, _ in parts)))


def best_matches(left: DataFrame, right: DataFrame, w: Weights, threshold: int = 50, light: int | None = None) -> DataFrame:
    """(l, r, score, reasons): the best right row of each left row that reaches the threshold; ties go to the first. left may be
    keyed() already, for several matches of equal evidence on its side."""
    tag = lambda df, t: df.select(*(F.col(c).alias(f"{t}_{c}" if c != "id" else t) for c in df.columns if c != "kind"))
    left, right = left if "keys" in left.columns else keyed(left, w, True), keyed(right, w, False)
    pairs = candidates(left, right, w, threshold, light)
    plain = ["id", "amount", "party", "number", "account", "tokens", "tie"]
    pairs = pairs.join(tag(left.select(*plain), "l"), "l").join(tag(right.select(*plain), "r"), "r")
    found = score(pairs, w).where(F.col("score") >= threshold)
    best = found.groupBy("l").agg(F.min_by(F.struct("r", "score", "reasons"), F.struct(-F.col("score"), "r_tie")).alias("x"))
    return best.select("l", "x.*")


def comparison(ledger: DataFrame, by_bank: DataFrame, by_mail: DataFrame) -> DataFrame:
    """ledger(id, payment_status) with its bank and mail match -> flags of what is missing where."""
    b, m = by_bank.select(F.col("l").alias("id"), F.col("r").alias("bank_id"), F.col("score").alias("bank_score")), by_mail.select(F.col("l").alias("id"), F.col("r").alias("mail_id"), F.col("score").alias("mail_score"))
    both = ledger.join(b, "id", "left").join(m, "id", "left")
    paid = F.col("payment_status").isin("paid", "partially_paid")
    return both.withColumn("missing_in_mail", F.col("mail_id").isNull()).withColumn("paid_without_bank", paid & F.col("bank_id").isNull()).withColumn("unpaid_but_bank", (F.col("payment_status") == "unpaid") & F.col("bank_id").isNotNull())


def unmatched(rows: DataFrame, id_: str, matches: DataFrame) -> DataFrame:
    return rows.join(matches.select(F.col("r").alias(id_)), id_, "left_anti")


def strict_check(ledger: DataFrame, bank: DataFrame, matches: DataFrame) -> DataFrame:
    """The five-way status of ledger rows (id, payment_status) and bank debits (id), of matches at the high threshold."""
    both = ledger.join(matches.select(F.col("l").alias("id"), F.col("r").alias("bank_id")), "id", "left")
    found, paid = F.col("bank_id").isNotNull(), F.col("payment_status").isin("paid", "partially_paid")
    status = F.when(found & paid, "ok_paid").when(found & (F.col("payment_status") == "unpaid"), "bank_paid_ledger_unpaid").when(~found & paid, "ledger_paid_no_bank_match").otherwise("unpaid_no_bank_match")
    rest = unmatched(bank.select(F.col("id").alias("bank_id")), "bank_id", matches)
    return both.select("id", "bank_id", status.alias("status")).unionByName(rest.select(F.lit(None).cast("long").alias("id"), "bank_id", F.lit("bank_debit_no_ledger").alias("status")))


def reconcile(ledger: DataFrame, bank: DataFrame) -> DataFrame:
    """Full outer on (number, amount), numbers compared by their letters and digits alone."""
    both = ledger.alias("l").join(bank.alias("b"), (F.col("l.number") == F.col("b.number")) & (F.col("l.amount") == F.col("b.amount")), "full_outer")
    return both.select(F.coalesce("l.number", "b.number").alias("number"), F.coalesce("l.amount", "b.amount").alias("amount"), F.when(F.col("l.number").isNull(), "bank").when(F.col("b.number").isNull(), "ledger").otherwise("both").alias("side"))


def first_compatible(bank: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, row_id): for each bank row the first row, by position, of the same cents and a matching company name.

    bank(id, amount, party, remittance), rows(row_id, amount, supplier, position). Candidates share the amount and a word
    of the supplier's name; of rows of equal amount and supplier only the first is one.
    """
    r = rows.where("amount <> 0").groupBy(F.bround("amount", 2).alias("cent"), "supplier").agg(F.min_by("row_id", "position").alias("row_id"), F.min("position").alias("position"))
    b = bank.where("amount <> 0").select("id", F.bround("amount", 2).alias("cent"), company_tokens(F.col("party")).alias("p"), company_tokens(F.concat_ws(" ", "party", "remittance")).alias("t"))
    words = r.withColumn("s", company_tokens(F.col("supplier"))).withColumn("word", F.explode("s"))
    pairs = b.withColumn("word", F.explode("t")).join(words, ["cent", "word"]).where(companies_match(F.col("s"), F.col("p")) | companies_match(F.col("s"), F.col("t")))
    return pairs.groupBy("id").agg(F.min_by("row_id", "position").alias("row_id"))


def live_rows(items: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, row_id): for each payment (id, number, amount, supplier) the ledger row of its number and amount, a matching
    supplier first, then by position."""
    both = items.join(rows.select("row_id", "number", "amount", F.col("supplier").alias("_s"), "position"), ["number", "amount"])
    fits = companies_match(company_tokens(F.col("supplier")), company_tokens(F.col("_s")))
    return both.groupBy("id").agg(F.min_by("row_id", F.struct((~F.coalesce(fits, F.lit(False))).alias("no"), "position")).alias("row_id"))


def payment_candidates(bank: DataFrame, sent: DataFrame, local: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, row_id): bank debits (id, number, amount) not sent yet, unknown to the local bills (number, amount), whose number
    and amount an unpaid ledger row (row_id, number, amount, paid, position) has; the first of these."""
    rest = bank.join(sent, "id", "left_anti").join(local, ["number", "amount"], "left_anti")
    unpaid = ledger.where("not paid").groupBy("number", "amount").agg(F.min_by("row_id", "position").alias("row_id"))
    return rest.join(unpaid, ["number", "amount"]).select("id", "row_id")


def paid_fields(bills: DataFrame, matches: DataFrame, bank: DataFrame) -> DataFrame:
    """Bills after a reconciliation: paid by the last bank row that matches; confirmed ones without one are unmatched."""
    hit = matches.join(bank.select(F.col("txn_id").alias("l"), F.col("amount").alias("paid_amount"), F.col("booking_date").alias("paid_date")), "l")
    last = hit.groupBy(F.col("r").alias("bill_id")).agg(F.max_by(F.struct("paid_amount", "paid_date"), "l").alias("x"))
    both = bills.join(last, "bill_id", "left")
    status = F.when(F.col("x").isNotNull(), "paid").when((F.col("status") == "confirmed") & (F.col("payment_status") != "paid"), "unmatched").otherwise(F.col("payment_status"))
    return both.select("bill_id", status.alias("payment_status"), "x.paid_amount", "x.paid_date")


def keep_best(rows: DataFrame, key: str, *order) -> DataFrame:
    """is_duplicate is false for the first row of each key by `order`, true for the rest."""
    return rows.withColumn("is_duplicate", F.row_number().over(W.partitionBy(key).orderBy(*order)) > 1)


def statement_summary(bank: DataFrame) -> DataFrame:
    """By currency and direction: rows, amount, first and last date; with a net row for each currency (direction null)."""
    signed = F.when(F.col("direction") == "DBIT", -F.col("amount")).otherwise(F.col("amount"))
    rows = bank.select("currency", "direction", "amount", signed.alias("net"), "booking_date")
    return rows.rollup("currency", "direction").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.sum("net").alias("net"), F.min("booking_date").alias("first_date"), F.max("booking_date").alias("last_date"))
