"""Outer formats: bank statements, ledger pulls, CSV, mail, payment files and bill payloads."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fields import normal_date
from ..functions.numeric import normalize_amount
from ..functions.text import valid_iban

PULL = "array<struct<GLBId:string,BatchDate:string,CurrencyCode:string,Entries:array<struct<EntryId:string,Id:string,AccountCode:string,Debit:string,Credit:string,Allocations:array<struct<Code:string,Amount:string>>>>>>"
PARTY = "struct<Nm:string,Pty:struct<Nm:string>>"
DETAIL = f"struct<Refs:struct<EndToEndId:string>,RltdPties:struct<Dbtr:{PARTY},Cdtr:{PARTY},DbtrAcct:struct<Id:struct<IBAN:string>>,CdtrAcct:struct<Id:struct<IBAN:string>>>,RmtInf:struct<Ustrd:array<string>,Strd:array<struct<CdtrRefInf:struct<Ref:string>>>>>"
ENTRY = f"array<struct<Amt:struct<_VALUE:string,_Ccy:string>,CdtDbtInd:string,BookgDt:struct<Dt:string,DtTm:string>,ValDt:struct<Dt:string,DtTm:string>,NtryRef:string,BkTxCd:struct<Domn:struct<Cd:string>,Prtry:struct<Cd:string>>,NtryDtls:array<struct<TxDtls:array<{DETAIL}>>>>>"
STATEMENT = f"Acct struct<Id:struct<IBAN:string>>, Ntry {ENTRY}"


def first_filled(*cols):
    """The first text that isn't empty, or an empty one."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cols), F.lit(""))


def read_statements(spark: SparkSession, path: str, tag: str = "Stmt") -> DataFrame:
    """One row for each transaction of ISO 20022 statements (`tag` Stmt, Rpt or Ntfctn); an entry without details gives one row.

    An entry of several transactions repeats its whole amount on each, as statements state it. The party is the debtor's, else
    the creditor's; remittance texts and references are joined, each once, in order.
    """
    rows = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(STATEMENT).load(path)
    e = rows.select(F.col("Acct.Id.IBAN").alias("account_iban"), F.explode("Ntry").alias("e"))
    details = F.flatten(F.coalesce(F.col("e.NtryDtls.TxDtls"), F.array().cast(f"array<array<{DETAIL}>>")))
    t = e.select("account_iban", "e", F.explode_outer(details).alias("t"))
    name = [F.col(f"t.RltdPties.{role}.{x}") for role in ("Dbtr", "Cdtr") for x in ("Nm", "Pty.Nm")]
    said = F.concat(F.coalesce("t.RmtInf.Ustrd", F.array().cast("array<string>")), F.coalesce("t.RmtInf.Strd.CdtrRefInf.Ref", F.array().cast("array<string>")))
    texts = F.array_distinct(F.filter(F.transform(said, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))
    day = lambda c: F.substring(first_filled(F.col(f"e.{c}.Dt"), F.col(f"e.{c}.DtTm")), 1, 10).try_cast("date")
    return t.select(
        day("BookgDt").alias("booking_date"),
        day("ValDt").alias("value_date"),
        F.col("e.CdtDbtInd").alias("direction"),
        F.regexp_replace("e.Amt._VALUE", ",", ".").try_cast("decimal(20,6)").alias("amount"),
        F.col("e.Amt._Ccy").alias("currency"),
        first_filled(*name).alias("party"),
        first_filled(F.col("t.RltdPties.DbtrAcct.Id.IBAN"), F.col("t.RltdPties.CdtrAcct.Id.IBAN")).alias("party_iban"),
        F.array_join(texts, " | ").alias("remittance"),
        F.coalesce("e.NtryRef", F.lit("")).alias("entry_ref"),
        first_filled(F.col("e.BkTxCd.Domn.Cd"), F.col("e.BkTxCd.Prtry.Cd")).alias("bank_tx_code"),
        "account_iban",
    )


def flatten_pull(raw: DataFrame, column: str = "json") -> DataFrame:
    """Nested ledger batches as JSON text -> a row for each allocation (or entry without one); ids by the first alias that is filled."""
    b = raw.select(F.explode(F.from_json(column, PULL)).alias("b")).select("b.*")
    e = b.select(F.col("GLBId").alias("batch_id"), F.col("BatchDate").alias("batch_date"), F.col("CurrencyCode").alias("currency"), F.explode_outer("Entries").alias("e"))
    a = e.select("batch_id", "batch_date", "currency", F.coalesce(F.nullif("e.EntryId", F.lit("")), F.nullif("e.Id", F.lit(""))).alias("entry_id"), "e.AccountCode", "e.Debit", "e.Credit", F.explode_outer("e.Allocations").alias("a"))
    money = lambda c: F.col(c).try_cast("decimal(20,6)")
    return a.select("batch_id", F.col("batch_date").try_cast("date").alias("batch_date"), "currency", "entry_id", F.col("AccountCode").alias("account_code"), money("Debit").alias("debit"), money("Credit").alias("credit"), F.col("a.Code").alias("dimension_code"), money("a.Amount").alias("amount"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte order mark at the head is dropped by the reader."""
    return spark.read.option("header", "true").option("encoding", "UTF-8").option("multiLine", "true").csv(path)


def write_split(rows: DataFrame, path: str, by: str) -> None:
    """One folder of CSV for each value of `by`, in one pass."""
    rows.write.partitionBy(by).option("header", "true").mode("overwrite").csv(path)


def _xml(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def safe_text(c, most: int):
    """White space collapsed, marks that payment files don't allow left out; NA for nothing."""
    kept = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), r"(?U)[^\w\s.,:/+()'&-]", "")
    return F.coalesce(F.nullif(F.left(kept, F.lit(most)), F.lit("")), F.lit("NA"))


def safe_id(c, most: int = 35):
    kept = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9-]", "-"), F.lit("-"))
    return F.left(F.coalesce(F.nullif(kept, F.lit("")), F.lit("PAYMENT")), F.lit(most))


def payments(rows: DataFrame, debtor_iban: str, debtor_name: str, today) -> DataFrame:
    """(payment_id, error, amount, execution_date, xml): a payment block for each row; what is wrong with a row is told instead.

    rows(payment_id, number, amount, iban, party, due_date, currency). The date of execution is the due date, or today where
    that is past. Amounts round half up to cents; the creditor's account must be of valid length.
    """
    if not debtor_iban:
        raise ValueError("a debtor IBAN is needed")
    amount = F.round(F.regexp_replace(F.regexp_replace("amount", " ", ""), ",", ".").try_cast("decimal(20,6)"), 2).cast("decimal(20,2)")
    iban = F.regexp_replace(F.upper(F.coalesce("iban", F.lit(""))), "[^A-Z0-9]", "")
    error = F.when(amount.isNull() | (amount <= 0), "amount").when(~iban.rlike("^[A-Z]{2}[0-9]{2}") | ~valid_iban(iban), "iban").when(F.trim(F.coalesce("party", F.lit(""))) == "", "party")
    when = F.greatest(F.coalesce(F.substring("due_date", 1, 10).try_cast("date"), F.lit(today).cast("date")), F.lit(today).cast("date"))
    text = F.when(F.lower("number").startswith("arve"), F.col("number")).otherwise(F.concat(F.lit("Arve "), "number"))
    el = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    money, name = amount.cast("string"), F.lit(debtor_name)
    block = F.concat(
        F.lit("<PmtInf>"), el("PmtInfId", safe_id(F.concat(F.lit("PMT-"), F.col("payment_id").cast("string"), F.lit("-"), "number"))), F.lit("<PmtMtd>TRF</PmtMtd><BtchBookg>true</BtchBookg><NbOfTxs>1</NbOfTxs>"), el("CtrlSum", money),
        F.lit("<PmtTpInf><SvcLvl><Cd>SEPA</Cd></SvcLvl></PmtTpInf>"), el("ReqdExctnDt", when.cast("string")), el("Dbtr", el("Nm", _xml(safe_text(name, 70)))), F.lit(f"<DbtrAcct><Id><IBAN>{debtor_iban}</IBAN></Id></DbtrAcct><ChrgBr>SLEV</ChrgBr><CdtTrfTxInf>"),
        el("PmtId", el("EndToEndId", safe_id(F.col("number")))), F.lit("<Amt><InstdAmt Ccy=\""), F.col("currency"), F.lit("\">"), money, F.lit("</InstdAmt></Amt>"), el("Cdtr", el("Nm", _xml(safe_text(F.col("party"), 70)))),
        el("CdtrAcct", el("Id", el("IBAN", iban))), el("RmtInf", el("Ustrd", _xml(safe_text(text, 140)))), F.lit("</CdtTrfTxInf></PmtInf>"),
    )
    return rows.select("payment_id", error.alias("error"), F.when(error.isNull(), amount).alias("amount"), when.alias("execution_date"), F.when(error.isNull(), block).alias("xml"))


def payment_header(blocks: DataFrame, message_id: str, debtor_name: str, created: str) -> DataFrame:
    """One row: the group header of the blocks without errors, with their number and control sum."""
    g = blocks.where("error is null").agg(F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(20,2)").alias("total"))
    el = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    head = F.concat(el("MsgId", safe_id(F.lit(message_id))), el("CreDtTm", F.lit(created)), el("NbOfTxs", F.col("n").cast("string")), el("CtrlSum", F.col("total").cast("string")), el("InitgPty", el("Nm", _xml(safe_text(F.lit(debtor_name), 70)))))
    return g.select(F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><Document xmlns="urn:iso:std:iso:20022:tech:xsd:pain.001.001.03"><CstmrCdtTrfInitn><GrpHdr>'), head, F.lit("</GrpHdr>")).alias("xml"))


def write_payments(blocks: DataFrame, path: str, **header) -> None:
    """Text files that, read in order of their names, are one document: header, blocks, end."""
    spark = blocks.sparkSession
    payment_header(blocks, **header).coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    blocks.where("error is null").select("xml").write.mode("overwrite").text(f"{path}/part=1")
    spark.createDataFrame([("</CstmrCdtTrfInitn></Document>",)], "xml string").coalesce(1).write.mode("overwrite").text(f"{path}/part=2")


def flatten_dimensions(raw: DataFrame, column: str = "json") -> DataFrame:
    """(dimension, external_id, code, name) of dimension values as JSON: a list, or an object with the list under Dimensions,
    each with its nested Values."""
    value = "struct<Id:string,DimValueId:string,Code:string,DimValueCode:string,Name:string,DimValueName:string>"
    item = f"array<struct<Id:string,DimId:string,Name:string,Values:array<{value}>>>"
    both = F.coalesce(F.from_json(column, item), F.from_json(column, f"struct<Dimensions:{item}>")["Dimensions"])
    whole = F.when(F.ltrim(column).startswith("{"), F.from_json(column, f"struct<Dimensions:{item}>")["Dimensions"]).otherwise(both)
    d = raw.select(F.explode_outer(whole).alias("d")).select("d.*").select(first_filled(F.col("Id"), F.col("DimId")).alias("dimension"), F.explode_outer("Values").alias("v"))
    pick = lambda *c: first_filled(*(F.col(f"v.{x}") for x in c))
    return d.where("v is not null").select("dimension", pick("DimValueId", "Id").alias("external_id"), pick("DimValueCode", "Code").alias("code"), pick("DimValueName", "Name").alias("name"))


#: Tags of an electronic bill for each field, in order.
E_INVOICE = {
    "amount_total": ["TotalSum", "TotalAmount", "PayableAmount", "InvoiceSum"],
    "vat_amount": ["VATSum", "TaxAmount", "TotalVATSum"],
    "invoice_date": ["InvoiceDate", "IssueDate", "Date"],
    "due_date": ["DueDate", "PaymentDate"],
    "issuer_reg_code": ["RegNumber", "RegistrationNumber", "SellerRegNumber"],
    "issuer_vat_no": ["VATRegNumber", "SellerVATRegNumber", "TaxRegistrationNumber"],
    "payment_details": ["IBAN", "AccountNumber", "SellerPartyIBAN"],
}


def _tag_texts(xml: str | None, tags: list[str]) -> dict[str, str]:
    """Tag in lower case -> whole text of the first element of that name whose own first text isn't blank; read once."""
    wanted, out = {t.lower() for t in tags}, {}
    for e in ET.fromstring(xml).iter() if xml is not None else ():
        tag = e.tag.rpartition("}")[2].lower()
        if tag in wanted and tag not in out and (e.text or next((x.tail for x in e if x.tail), "")).strip(" \t\r\n"):
            out[tag] = "".join(e.itertext())
    return out


def e_invoice(raw: DataFrame, column: str, *keep: str) -> DataFrame:
    """Fields of electronic bills in XML by their first tag that is there, whatever its case and namespace."""
    tags = [tag for of in E_INVOICE.values() for tag in of]
    rows = raw.select(*keep, F.col(column).cast("string").alias("_xml"))

    def each(batches):
        for b in batches:
            read = [_tag_texts(x, tags) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array([r.get(t.lower()) for r in read], pa.string()) for t in tags)], [*keep, *tags])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[: len(keep)]), *(f"`{t}` string" for t in tags)])
    texts = rows.mapInArrow(each, schema)
    found = {k: first_filled(*(F.col(t) for t in of)) for k, of in E_INVOICE.items()}
    for k in ("amount_total", "vat_amount"):
        found[k] = normalize_amount(found[k])
    for k in ("invoice_date", "due_date"):
        found[k] = normal_date(found[k])
    found["payment_details"] = F.regexp_replace(found["payment_details"], " ", "")
    return texts.select(*keep, *(c.alias(k) for k, c in found.items()))


def archive_manifest(bills: DataFrame) -> DataFrame:
    """(bill_id, source, target): where each attachment of a confirmed bill goes: year, month, kind, number and issuer. No file
    is copied."""
    name = lambda c, other: F.coalesce(F.nullif(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N} ._()-]", "_")), F.lit("")), F.lit(other))
    parts = F.filter(F.transform(F.split("attachment_names", ";"), lambda x: F.trim(x)), lambda x: x.rlike(r"(?i)\.(pdf|xml|asice|bdoc|ddoc|xlsx|xls|csv)$"))
    rows = bills.where("status = 'confirmed'").select("*", F.posexplode(parts).alias("i", "source"))
    day = F.col("bill_date").cast("string")
    at = F.when(F.length(day) >= 7, F.concat_ws("/", F.substring(day, 1, 4), F.substring(day, 6, 2))).otherwise("unknown-year/unknown-month")
    folder = F.when(F.col("kind") == "sale", "muugiarved").otherwise("ostuarved")
    stem = F.concat_ws("_", name(F.col("number"), "arve"), name(F.col("issuer"), "tundmatu"), F.when(F.col("i") > 0, (F.col("i") + 1).cast("string")))
    return rows.select("bill_id", "source", F.concat(at, F.lit("/"), folder, F.lit("/"), stem, F.lower(F.regexp_extract("source", r"(\.[^.]*)$", 1))).alias("target"))


def store_documents(files: DataFrame) -> DataFrame:
    """binaryFile rows or (path, content) -> (path, sha256, size, mime, version): the first version of each document."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    kinds = {"pdf": "application/pdf", "xml": "application/xml", "csv": "text/csv", "json": "application/json", "txt": "text/plain", "html": "text/html"}
    table = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"), F.coalesce(F.try_element_at(table, suffix), F.lit("application/octet-stream")).alias("mime"), F.lit(1).alias("version"))


def audit_rows(actions: DataFrame, event_type: str, object_type: str, message) -> DataFrame:
    """One audit row for each action(object_id, organization_id, actor, at, metadata map)."""
    return actions.select(F.lit(event_type).alias("event_type"), F.lit(object_type).alias("object_type"), F.col("object_id").cast("string").alias("object_id"), "organization_id", "actor", "at", message.alias("message"), F.to_json("metadata").alias("metadata"))


def append_audit(actions: DataFrame, path: str) -> None:
    actions.write.mode("append").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_register(rows: DataFrame, path: str, order: list) -> None:
    """An ordered dump: files follow each other in the order of their names."""
    rows.orderBy(*order).write.mode("overwrite").option("header", "true").csv(path)


def bill_payloads(bills: DataFrame, lines: DataFrame, columns: list[str]) -> DataFrame:
    """(bill_id, payload): a nested JSON document for each bill with its lines, of these columns, in order."""
    rows = lines.groupBy("bill_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    both = bills.join(rows, "bill_id", "left")
    return both.select("bill_id", F.to_json(F.struct("number", "issuer", F.col("amount").cast("string").alias("total"), "rows")).alias("payload"))


def parse_mail(raw: DataFrame, column: str = "content") -> DataFrame:
    """MIME bytes -> subject, sender, recipients and plain text; a message that can't be parsed has nulls."""
    @F.pandas_udf("subject string, sender string, recipients array<string>, body string")
    def parse(contents: pd.Series) -> pd.DataFrame:
        from email import message_from_bytes, policy
        from email.utils import getaddresses

        def one(raw):
            if raw is None:
                return None, None, None, None
            m = message_from_bytes(raw, policy=policy.default)
            body = m.get_body(("plain", "html"))
            to = [a.lower() for _, a in getaddresses([str(x) for h in ("to", "cc", "bcc") for x in m.get_all(h, [])]) if a]
            sender = [a.lower() for _, a in getaddresses([str(m.get("from", ""))]) if a]
            return str(m.get("subject", "")), sender[0] if sender else None, to, body.get_content() if body is not None else ""

        return pd.DataFrame([one(x) for x in contents], columns=["subject", "sender", "recipients", "body"])

    return raw.withColumn("m", parse(column)).select(*raw.columns, "m.*")
