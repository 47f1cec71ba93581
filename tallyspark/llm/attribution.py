"""Token counts by section: documents are encoded once, whole, and token spans are joined to section spans.

Sections are a caller's spans (``spans``: a column of arrays of (kind, start, stop), in order and apart; what lies
between them counts as kind ``outside``), the fields that ``with_fields`` joins to one text, or else the lines, each with
its line end, of a kind: ``heading`` (starts with #), ``list`` (starts with -, * or a
number and a dot), ``table`` (holds a | or a tab), ``blank`` (no word) or ``prose``. They tile the text. The byte
lengths of the vocabulary turn ids into spans, and bytes into characters.

A token that crosses a boundary goes by ``rule``: "most" to the section that holds most of its characters, the earlier
one at a tie; "first" to the section of its first character. A character cut into several tokens belongs to the token
that holds its first byte; a token without a character counts where the next character would start, or in the last
section. The counts of a document's sections always sum to its tokens.

Defined cases: null or empty text is one empty section of kind blank without tokens; rows are handled one by one,
whatever their ids; null spans are none, and spans are clipped to the text; extra columns are ignored; an empty table
gives no row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from .bpe import RANKS, read_ranks, runs
from .common import documents

KINDS = ("blank", "heading", "list", "table", "prose")
ROWS = "doc_id long, section int, kind string, start long, stop long, n_tokens long, n_crossing long, doc_tokens long"
_mark = re.compile(r"(#)|([-*]|[0-9]+\.)[ \t]")


def kind(line: str) -> int:
    if not line.strip():
        return 0
    if m := _mark.match(line):
        return 1 if m[1] else 2
    return 3 if "|" in line or "\t" in line else 4


def sections(text: str) -> tuple[list[int], list[int]]:
    """(start characters, kinds) of the lines that tile the text."""
    starts, kinds, at = [], [], 0
    for line in text.split("\n"):
        if at < len(text) or not starts:  # no section behind a last line end
            starts.append(at)
            kinds.append(KINDS[kind(line)])
        at += len(line) + 1
    return starts, kinds


def given(text: str, spans: list[dict] | None) -> tuple[list[int], list[str]]:
    """(start characters, kinds) of sections that tile the text: the spans, clipped to it, and what lies between."""
    starts, kinds, at = [], [], 0
    for s in spans or ():
        a, b = min(max(s["start"], at), len(text)), min(s["stop"], len(text))
        if a >= b:
            continue
        if a > at:
            starts.append(at)
            kinds.append("outside")
        starts.append(a)
        kinds.append(s["kind"])
        at = b
    if at < len(text) or not starts:
        starts.append(at)
        kinds.append("outside")
    return starts, kinds


def with_fields(rows: DataFrame, fields: list[str], doc_id: str = "doc_id", sep: str = "\n") -> DataFrame:
    """(doc_id, text, spans): the fields joined to one text, null as empty, and the span of each, for section_tokens()."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    ends, at = [], F.lit(0)
    for p in parts:
        ends.append((at, at + F.char_length(p)))
        at = at + F.char_length(p) + len(sep)
    spans = F.array(*(F.struct(F.lit(f).alias("kind"), a.cast("long").alias("start"), b.cast("long").alias("stop")) for f, (a, b) in zip(fields, ends)))
    return rows.select(F.col(doc_id).alias("doc_id"), F.concat_ws(sep, *parts).alias("text"), spans.alias("spans"))


def token_spans(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token, from the text's bytes and the tokens' byte lengths."""
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    chars = np.r_[0, np.cumsum(lead)]  # characters that start before a byte
    ends = np.cumsum(sizes)
    return chars[ends - sizes], chars[ends]


def attribute(first: np.ndarray, stop: np.ndarray, starts: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, by interval join of sorted token spans to sorted section starts."""
    n = len(starts)
    own = np.searchsorted(starts, first, side="right") - 1
    last = np.searchsorted(starts, np.maximum(stop - 1, first), side="right") - 1
    crossing = own != last
    if rule == "most":
        ends = np.r_[starts[1:], np.iinfo(np.int64).max]
        for t in np.flatnonzero(crossing):
            s = np.arange(own[t], last[t] + 1)
            own[t] = s[np.argmax(np.minimum(ends[s], stop[t]) - np.maximum(starts[s], first[t]))]
    elif rule != "first":
        raise ValueError(f"rule is 'most' or 'first', not {rule!r}")
    return np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n)


def section_tokens(docs: DataFrame, rule: str = "most", name: str = RANKS, spans: str | None = None) -> DataFrame:
    """(doc_id, section, kind, start, stop, n_tokens, n_crossing, doc_tokens): a row for each section of each row."""

    def each(batches):
        import tiktoken

        ranks = read_ranks(name)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            size[i] = len(t)
        encode = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            texts, own = [t or "" for t in b.column(1).to_pylist()], b.column(2).to_pylist() if spans else None
            for s, e in runs([len(t) + 1 for t in texts], 2_000_000):
                out = []
                for i in range(s, e):
                    starts, kinds = given(texts[i], own[i]) if spans else sections(texts[i])
                    first, stop = token_spans(texts[i].encode(), size[np.array(encode(texts[i]), np.int64)])
                    n, crossing = attribute(first, stop, np.array(starts), rule)
                    out += zip([i] * len(n), range(len(n)), kinds, starts, [*starts[1:], len(texts[i])], n.tolist(), crossing.tolist(), [len(first)] * len(n))
                row, *cols = zip(*out)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.string()] + [pa.int64()] * 5))], ["doc_id", "section", "kind", "start", "stop", "n_tokens", "n_crossing", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([spans] if spans else [])).mapInArrow(each, ROWS)


def op10(spark, sf_dir: str) -> DataFrame:
    return section_tokens(documents(spark, sf_dir))
