"""Line dedup: lines whose key many documents share go; the result is a keep bitmap for each document.

Line keys become 128-bit hashes, range-partitioned by (key, document) and sorted by document and position within. One
streaming pass over each range emits the positions to drop. A key that crosses the edge of a range with fewer documents
than the threshold is left pending with its count, and the counts of all ranges are summed before it is decided, so a
hot key spreads over as many tasks as its rows need. With ``keep_first`` the first occurrence, by document and position,
stays; without it a key that is shared goes everywhere.

Defined cases: null or empty text is one empty line; keys shorter than ``min_chars`` never drop; rows with a null
doc_id count as one document; rows that repeat a doc_id with another text are treated by themselves but count once;
extra columns are ignored by the bitmaps; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ASCII_SPACE, ascii_lower, documents, packed, stage, with_key

DROP = "doc_id long, tkey long, pos int, h1 long, h2 long, n int, pending boolean"


def line_rows(keyed: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, doc_id, tkey, pos) of each line that could drop."""
    lines = keyed.select("doc_id", "tkey", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(ASCII_SPACE)))
    lines = lines.select("doc_id", "tkey", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    return lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "tkey", "pos")


def _stream(threshold: int, keep_first: bool = False):
    """Sorted (h1, h2, doc_id, tkey, pos) -> rows to drop and, at the edges of a range, counts still to be summed."""

    def rows(cols, take, n, pending):
        h1, h2, doc, tkey, pos = (c.filter(take) if isinstance(take, pa.Array) else c.slice(*take) for c in cols)
        k = len(h1)
        return pa.RecordBatch.from_arrays([doc, tkey, pos, h1, h2, pa.array(np.full(k, n, np.int32)), pa.array(np.full(k, pending))], ["doc_id", "tkey", "pos", "h1", "h2", "n", "pending"])

    def each(batches):
        first, held, key, docs, last = True, [], None, 0, None  # of the run that is open
        lead, lead_at = None, None  # its first row, where that may stay

        def close(edge):
            # nothing is known to follow: below the threshold only an edge run stays pending
            if docs < threshold and edge:
                for cols in held:
                    yield rows(cols, (0, len(cols[0])), 0, True)
            if edge and lead is not None:  # whether it is the first of all ranges is decided with the counts
                yield rows(lead, (0, 1), 0, True)
            if edge and key is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((None, pa.int64()), (None, pa.int64()), (None, pa.int32()), (key[0], pa.int64()), (key[1], pa.int64()), (docs, pa.int32()), (True, pa.bool_()))], ["doc_id", "tkey", "pos", "h1", "h2", "n", "pending"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = batch.columns
            a, b = cols[0].to_numpy(), cols[1].to_numpy()
            d = cols[2].fill_null(np.iinfo(np.int64).min).to_numpy()
            tkeys, spots = cols[3].to_numpy(), cols[4].to_numpy()
            start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            end = np.r_[start[1:], len(a)]
            new_doc = np.r_[True, d[1:] != d[:-1]]
            new_doc[start] = True
            count = np.add.reduceat(new_doc.astype(np.int64), start)
            drop = np.zeros(len(a), bool)
            for r in np.flatnonzero((count >= threshold) | (np.arange(len(start)) == 0) | (np.arange(len(start)) == len(start) - 1)):
                s, e, k = int(start[r]), int(end[r]), (int(a[start[r]]), int(b[start[r]]))
                if k == key:
                    docs += int(count[r]) - int(d[s] == last)
                else:
                    if key is not None:
                        yield from close(first)
                        first = False
                    elif r > 0:
                        first = False
                    held, key, docs = [], k, int(count[r])
                    if keep_first:
                        lead, lead_at = [c.slice(s, 1) for c in cols], (d[s], cols[3][s].as_py(), cols[4][s].as_py())
                own = np.arange(s, e)
                if lead is not None:  # rows that repeat the first row go its way
                    own = own[(d[s:e] != lead_at[0]) | (tkeys[s:e] != lead_at[1]) | (spots[s:e] != lead_at[2])]
                if docs >= threshold:
                    for h in held:
                        yield rows(h, (0, len(h[0])), 0, False)
                    held = []
                    drop[own] = True
                elif len(own):
                    held.append([c.take(pa.array(own)) for c in cols])
                last = d[e - 1]
            if drop.any():
                yield rows(cols, pa.array(drop), 0, False)
        if key is not None:
            yield from close(True)

    return each


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, tkey, drop): the sorted positions of the lines to drop, for documents that lose any."""
    lines = stage(line_rows(with_key(docs), min_chars), "line-rows")  # the ranges are drawn from it before it is dealt
    found = stage(lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "tkey", "pos").mapInArrow(_stream(min_docs, keep_first), DROP), "lines")
    pending = found.where("pending")
    full = pending.where("pos is null").groupBy("h1", "h2").agg(F.sum("n").alias("docs")).where(F.col("docs") >= min_docs)
    late = pending.where("pos is not null").join(full, ["h1", "h2"], "left_semi")
    if keep_first:
        at = F.struct("doc_id", "tkey", "pos")
        stays = late.groupBy("h1", "h2").agg(F.min(at).alias("stays"))
        late = late.join(stays, ["h1", "h2"]).where(~at.eqNullSafe(F.col("stays")))
    hits = found.where("not pending").select("doc_id", "tkey", "pos").unionByName(late.select("doc_id", "tkey", "pos"))
    return hits.groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def keep_bitmap(n: int, drop) -> bytes:
    keep = np.ones(n, bool)
    keep[np.asarray(drop, np.int64)] = False
    return zlib.compress(np.packbits(keep).tobytes())


def read_bitmap(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, tkey, n_lines, n_dropped, keep): a compressed bit for each line, 1 where it stays. No text is returned or shuffled."""
    sizes = with_key(docs).select("doc_id", "tkey", (F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.translate(F.coalesce("text", F.lit("")), "\n", "")) + 1).cast("long").alias("n_lines"))
    gone = dropped_lines(docs, min_docs, min_chars, keep_first)
    both = sizes.alias("s").join(gone.alias("g"), F.col("s.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("s.tkey") == F.col("g.tkey")), "left").select("s.doc_id", "s.tkey", "n_lines", F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))

    def each(batches):
        for b in batches:
            n, drop = b.column(2).to_pylist(), b.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(x) for x in drop], pa.int64()), pa.array([keep_bitmap(k, x) for k, x in zip(n, drop)], pa.binary())], ["doc_id", "tkey", "n_lines", "n_dropped", "keep"])

    return both.mapInArrow(each, "doc_id long, tkey long, n_lines long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All columns of docs with text reduced to the kept lines, plus n_lines and n_dropped as _n_lines and _n_dropped."""
    own = ("_n_lines", "_n_dropped")
    maps = bitmaps.dropDuplicates(["doc_id", "tkey"]).select(F.col("doc_id").alias("i"), F.col("tkey").alias("t"), "n_lines", "n_dropped", "keep")
    both = packed(docs, *own).join(maps, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tkey") == F.col("t")), "left")
    both = both.select("row", "n_lines", "n_dropped", F.when(F.col("n_dropped") > 0, F.col("keep")).alias("keep"))
    out = both.select("row.*", F.col("n_lines").alias(own[0]), F.col("n_dropped").alias(own[1])).schema

    def each(batches):
        for b in batches:
            cols = dict(zip(out.names, b.column(0).flatten()))
            texts, n, keep = cols["text"].to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            cut = [t if k is None else "\n".join(x for x, y in zip((t or "").split("\n"), read_bitmap(k, m)) if y) for t, m, k in zip(texts, n, keep)]
            cols["text"] = pa.array(cut, pa.string())
            yield pa.RecordBatch.from_arrays([*cols.values(), b.column(1), b.column(2)], out.names)

    return both.mapInArrow(each, out)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = apply_bitmaps(docs, line_bitmaps(docs))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: op8 for DuckDB.
SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT rid, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON s.key = k.key GROUP BY rid, doc_id"""
