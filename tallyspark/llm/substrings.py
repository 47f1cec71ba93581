"""Substring dedup by difference-cover anchors: later copies of long word passages go.

Of each document only the windows that start at positions of a difference cover modulo a period are hashed as anchors.
Whatever the two offsets of a passage of ``window`` words in two documents, the cover holds a shift at which both have
an anchor, and anchors are short enough to lie inside the passage. Anchors that two documents share are then extended:
every window around them is hashed with 128 bits, and a window goes where a smaller doc_id has it too.

Before each shuffle a task settles what its own documents decide: a passage that many of them share leaves a task as one
row, so no key gathers more rows than there are task chunks (or than one document repeats it). Positions travel packed.
Shuffle files of a stage go when its table is written.

Defined cases: null, empty or short text loses nothing; windows within one document don't count; rows with a null doc_id
stay as they are and remove nothing elsewhere; rows of equal doc_id do not remove each other's words; extra columns stay;
an empty table gives no row.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .bpe import runs
from .common import documents, packed, stage

WINDOW, PERIOD = 50, 31
BASE = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1_500_000  # words of the documents whose rows a task settles together


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The smallest set that holds 0 and 1 and whose differences modulo the period are all residues."""
    for k in range(2, period + 1):
        for rest in combinations(range(2, period), k - 2):
            d = (0, 1, *rest)
            if len({(a - b) % period for a in d for b in d}) == period:
                return d
    return (0,)


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown as documents need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int):
        if len(self.up) < n:
            size = 2 * n
            inverse = pow(int(BASE), -1, 1 << 64)
            self.up = np.r_[np.uint64(1), np.cumprod(np.full(size, BASE))]
            self.down = np.r_[np.uint64(1), np.cumprod(np.full(size, np.uint64(inverse)))]
        return self.up[:n], self.down[:n]


_powers = Powers()


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def window_hashes(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of the `width` words from each position of `at`."""
    up, down = _powers.of(len(h))
    s = np.r_[np.uint64(0), np.cumsum(h * up)]
    return (s[at + width] - s[at]) * down[at]


def pack_by(rows: np.ndarray, pos: np.ndarray) -> list[tuple[int, bytes]]:
    """(row, its positions as packed int32) for each row number."""
    order = np.lexsort((pos, rows))
    r, p = rows[order], pos[order].astype("<i4")
    cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    return [(int(r[a]), p[a:b].tobytes()) for a, b in zip(cut, np.r_[cut[1:], len(r)])]


def unpack(spots) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(spots or ()), "<i4")).astype(np.int64)


def same_as_before(*cols: np.ndarray) -> np.ndarray:
    """True where all columns equal those of the row before."""
    out = np.ones(len(cols[0]), bool)
    out[:1] = False
    for c in cols:
        out[1:] &= c[1:] == c[:-1]
    return out


def run_ends(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first row of its run and the row behind it; new: True where a run starts."""
    start = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    return start[which], np.r_[start[1:], len(new)][which]


ANCHORS = "h1 long, h2 long, doc_id long, tkey long, pos int, spots binary"


def _batch(h1, h2, doc, tkey, pos, spots=None):
    n = len(pos)
    return pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(doc, pa.int64()), pa.array(tkey, pa.int64()), pa.array(pos, pa.int32()), pa.array(spots, pa.binary()) if spots is not None else pa.nulls(n, pa.binary())], ["h1", "h2", "doc_id", "tkey", "pos", "spots"])


def _settle(h1, h2, row, pos, ids, keys, anchors: bool):
    """Rows for the shuffle from one chunk's hashes: what its own documents decide comes packed, the rest row by row.

    For anchors a hash of two documents is shared, and one row (pos -1) says so to other tasks. For windows all but the
    smallest document lose theirs, and that document's rows go on.
    """
    doc = ids[row]
    order = np.lexsort((pos, row, doc, h2, h1))
    h1, h2, doc, row, pos = h1[order], h2[order], doc[order], row[order], pos[order]
    first, end = run_ends(~same_as_before(h1, h2))
    if anchors:
        settled = doc[first] != doc[end - 1]
        go_on = ~settled
        heads = np.flatnonzero(settled & (np.arange(len(h1)) == first))
        yield _batch(h1[heads].view(np.int64), h2[heads].view(np.int64), doc[heads], keys[row[heads]], np.full(len(heads), -1))
    else:
        settled = doc != doc[first]
        go_on = ~settled
    yield _batch(h1[go_on].view(np.int64), h2[go_on].view(np.int64), doc[go_on], keys[row[go_on]], pos[go_on])
    if packed := pack_by(row[settled], pos[settled]):
        r = np.array([x[0] for x in packed])
        # their own place in the shuffle, spread by document
        yield _batch(ids[r] * np.int64(0x5851F42D4C957F2D) ^ keys[r], np.zeros(len(r), np.int64), ids[r], keys[r], np.full(len(r), -2), [x[1] for x in packed])


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    width = window - period + 1

    def each(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            all_ids, all_keys = b.column(0).to_numpy(), b.column(2).to_numpy()
            for s, e in runs([len(t) // 6 + 1 for t in texts], CHUNK):
                hs, rows, ps = [], [], []
                for i in range(s, e):
                    words = texts[i].encode().split()
                    if len(words) < window:
                        continue
                    at = (np.arange(0, len(words), period)[:, None] + np.array(cover)).ravel()
                    at = at[at <= len(words) - width]
                    hs.append(window_hashes(word_hashes(words, 1), at, width))
                    ps.append(at)
                    rows.append(np.full(len(at), i))
                if hs:
                    h = np.concatenate(hs)
                    yield from _settle(h, np.zeros(len(h), np.uint64), np.concatenate(rows), np.concatenate(ps), all_ids, all_keys, True)

    return each


def _windows(window: int, period: int):
    def each(batches):
        for b in batches:
            texts, spots = b.column(1).to_pylist(), b.column(3).to_pylist()
            all_ids, all_keys = b.column(0).to_numpy(), b.column(2).to_numpy()
            for s, e in runs([sum(map(len, x)) * 4 + 1 for x in spots], CHUNK):
                h1, h2, rows, ps = [], [], [], []
                for i in range(s, e):
                    words, near = texts[i].encode().split(), unpack(spots[i])
                    n = len(words) - window + 1
                    if n <= 0:
                        continue
                    # the windows that hold a shared anchor start up to period - 1 words before it
                    d = np.zeros(n + 1, np.int64)
                    near = near[near < n + period - 1]
                    np.add.at(d, np.maximum(near - period + 1, 0), 1)
                    np.add.at(d, np.minimum(near + 1, n), -1)
                    at = np.flatnonzero(np.cumsum(d[:n]) > 0)
                    h1.append(window_hashes(word_hashes(words, 1), at, window))
                    h2.append(window_hashes(word_hashes(words, 2), at, window))
                    ps.append(at)
                    rows.append(np.full(len(at), i))
                if h1:
                    yield from _settle(np.concatenate(h1), np.concatenate(h2), np.concatenate(rows), np.concatenate(ps), all_ids, all_keys, False)

    return each


def _meet(anchors: bool):
    """Rows sorted by (h1, h2, doc_id) -> (doc_id, tkey, spots) of what the runs decide."""

    def out(doc, tkey, pos):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tkey), pa.array([p.tobytes() for p in pos.astype("<i4")], pa.binary())], ["doc_id", "tkey", "spots"])

    def decide(table):
        h1, h2, doc, tkey, pos = (table.column(i).to_numpy() for i in range(5))
        packed = np.flatnonzero(pos == -2)
        if len(packed):
            yield pa.RecordBatch.from_arrays([pa.array(doc[packed]), pa.array(tkey[packed]), table.column(5).combine_chunks().take(pa.array(packed))], ["doc_id", "tkey", "spots"])
        k = np.flatnonzero(pos != -2)
        h1, h2, doc, tkey, pos = h1[k], h2[k], doc[k], tkey[k], pos[k]
        if not len(h1):
            return
        first, end = run_ends(~same_as_before(h1, h2))
        hit = (doc[first] != doc[end - 1]) & (pos >= 0) if anchors else doc != doc[first]
        yield out(doc[hit], tkey[hit], pos[hit])

    def each(batches):
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            h1 = b.column(0).to_numpy()
            if held and held[-1].column(0)[-1].as_py() != h1[-1]:  # a run ends in this batch
                cut = int(np.searchsorted(h1, h1[-1]))
                yield from decide(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield from decide(pa.Table.from_batches(held))

    return each


def _by_hash(rows: DataFrame, anchors: bool) -> DataFrame:
    met = rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id").mapInArrow(_meet(anchors), "doc_id long, tkey long, spots binary")
    return met.groupBy("doc_id", "tkey").agg(F.collect_list("spots").alias("spots"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """(doc_id, tkey, spots): for documents that lose words, the packed starts of the windows that a smaller doc_id has."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tkey")).where("doc_id is not null and text is not null")
    # anchors only say where to look, so 16 bits of a row's key do to tell rows of equal doc_id apart
    few = F.col("tkey").bitwiseAND(0xFFFF)
    near = stage(_by_hash(texts.withColumn("tkey", few).mapInArrow(_anchors(window, period, difference_cover(period)), ANCHORS), True), "anchors")
    both = texts.withColumn("few", few).join(near.withColumnRenamed("tkey", "few"), ["doc_id", "few"]).select("doc_id", "text", "tkey", "spots")
    return stage(_by_hash(both.mapInArrow(_windows(window, period), ANCHORS), False), "windows")


def covered(starts: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """True for each of n words that a window from one of the starts covers."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + window, n), -1)
    return np.cumsum(d[:n]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """All columns of docs, with _n_words, _n_removed and, for texts that lose words, text as the kept words joined by spaces."""
    own = ("_n_words", "_n_removed")
    gone = repeated_windows(docs, window, period)
    both = packed(docs, *own).join(gone, ["doc_id", "tkey"], "left").select("row", "spots")
    schema = both.select("row.*", *(F.lit(0).cast("long").alias(c) for c in own)).schema

    def each(batches):
        for b in batches:
            cols, texts, n_words, n_removed = dict(zip(schema.names, b.column(0).flatten())), [], [], []
            for t, s in zip(cols["text"].to_pylist(), b.column(1).to_pylist()):
                words = (t or "").encode().split()
                drop = covered(unpack(s), len(words), window) if s else None
                n_words.append(len(words))
                n_removed.append(int(drop.sum()) if s else 0)
                texts.append(b" ".join(w for w, d in zip(words, drop.tolist()) if not d).decode() if s else t)
            cols["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], schema.names)

    return both.mapInArrow(each, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.array_join(F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), x -> x <> '')"), " ")
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


#: op4 for DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS u(i)),
gone AS (SELECT rid, i FROM starts QUALIFY doc_id > min(doc_id) OVER (PARTITION BY h)),
words AS (SELECT rid, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
marked AS (SELECT x.rid, x.i, word, max(g.i) OVER (PARTITION BY x.rid ORDER BY x.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS drop FROM words x LEFT JOIN gone g ON g.rid = x.rid AND g.i = x.i),
kept AS (SELECT rid, count(*) AS n, count(*) FILTER (WHERE drop) AS n_gone, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT drop) AS t FROM marked GROUP BY rid)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(n_gone, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.rid = d.rid"""
