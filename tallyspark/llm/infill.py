"""Fill-in-the-middle: documents are cut at line ends into prefix, middle and suffix, and put together in another order.

All of it is built-in string functions. A delimiter that no text may hold is made free by escaping, is appended to every
unit by one regexp_replace, and counted. substring_index then takes the first, the middle and the last units by rank,
the delimiters are dropped again and the escapes undone. Which units go where follows from a hash of the doc_id, so every
run and every partitioning cuts alike; nothing is shuffled.

``transform`` returns the text and its parts; ``restore`` gives back the text of a transformed one from its form alone.

Defined cases: null text is empty, of no unit, and plain, as is a text that holds one of the markers; a null doc_id is
hashed as an empty one; rows of equal ids are cut alike, one by one; extra columns are ignored; an empty table gives no
row. A last line without a line end is a unit; a carriage return belongs to its line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What ends a unit inside a text, and what escapes it.
END, ESCAPE = "\x01", "\x02"
UNIT = r"[^\n]*+\n|[^\n]++"


def escaped(c: Column) -> Column:
    """c without END: ESCAPE becomes ESCAPE b, END becomes ESCAPE a."""
    return F.replace(F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(END), F.lit(ESCAPE + "a"))


def unescaped(c: Column) -> Column:
    """The text of an escaped one, whose ends of units are dropped first."""
    whole = F.replace(c, F.lit(END), F.lit(""))
    return F.replace(F.replace(whole, F.lit(ESCAPE + "a"), F.lit(END)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2**32 from the hash of seed and doc_id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, k, 8), 16, 10).cast("long") for k in (1, 9, 17, 25)]


def _index(text: str, mark: str, rank: str) -> Column:
    return F.call_function("substring_index", F.col(text), F.lit(mark), F.expr(rank))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, text, n, form, prefix, middle, suffix, output) of each row.

    rate: the percentage of documents that are cut; spm: the percentage of these whose suffix comes first. The parts of a
    plain row are null and its output is its text.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", escaped(F.col("text")).alias("free"), *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed), 1)))
    d = d.withColumn("marked", F.regexp_replace("free", UNIT, "$0" + END))
    # END is one byte, and nothing else was added
    d = d.withColumn("n", (F.octet_length("marked") - F.octet_length("free")).cast("long"))
    one, other = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | held | (F.col("h3") % 100 >= rate)
    d = d.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm"))
    d = d.withColumn("a", F.least(one, other).cast("int")).withColumn("b", F.greatest(one, other).cast("int")).withColumn("left", _index("marked", END, "b"))
    # behind its last delimiter `marked` has an empty part, `left` hasn't
    parts = {"prefix": _index("marked", END, "a"), "middle": _index("left", END, "a - b"), "suffix": _index("marked", END, "cast(b - n - 1 as int)")}
    d = d.select("doc_id", "text", "n", "form", *(F.when(F.col("form") != "plain", unescaped(c)).alias(k) for k, c in parts.items()))
    spm_text = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm_text = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    return d.withColumn("output", F.when(F.col("form") == "spm", spm_text).when(F.col("form") == "psm", psm_text).otherwise(F.col("text")))


def restore(output: str = "output", form: str = "form") -> Column:
    """The text of a transformed one. No part holds a marker, so the first of each kind is the one that was set."""
    before = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    first = lambda then: F.substring(F.substring_index(before, then, 1), 4, 2**31 - 1)
    last = lambda then: F.substring_index(before, then, -1)
    spm = F.concat(last(PREFIX), middle, first(PREFIX))
    psm = F.concat(first(SUFFIX), middle, last(SUFFIX))
    return F.when(F.col(form) == "spm", spm).when(F.col(form) == "psm", psm).otherwise(F.col(output))


def op11(spark, sf_dir: str) -> DataFrame:
    d = transform(documents(spark, sf_dir))
    return d.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(), 256).alias("restored_sha256"),
    )


#: op11 for DuckDB, by lists of units.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(l[1:a], ''), '') AS pre, coalesce(array_to_string(l[a + 1:b], ''), '') AS mid, coalesce(array_to_string(l[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
