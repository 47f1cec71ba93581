"""Byte-level BPE by DuckDB's recursive queries inside each partition, and decoding by an ordered aggregation.

Token-position rows of the distinct pieces of text join the merge table, and every word contracts its leftmost pair of
minimum rank until no pair is left. A worker keeps the ids of pieces and chunks it has met in two bounded generations, so each is
contracted about once a worker. Decoding joins (document, position, id) rows to the vocabulary and aggregates the bytes
in order of position.

Pieces of more than ``SHORT`` bytes are contracted in slices that overlap, and put together where two slices both cut and
the tokens on both sides, contracted by themselves, stay two. That is exact: as long as no contraction of the whole piece
has crossed such a cut, what stands in two neighbouring tokens goes through the same contractions as in these two alone,
so the first that crossed a cut would cross it there too. Slices that don't meet so are joined and contracted anew.

Slices of more than ``LONG`` bytes go through a second recursion that contracts many pairs a step and keeps one state
a row: all places of the least rank at once, except where a contraction makes a pair of still lower rank (the ranks of
this vocabulary don't always rise). There the places behind it, as far as a token of lower rank can reach, wait. The
order of contractions that can't meet doesn't matter, so both give the same ids. Such a slice is only as long as no two
of its parts meet.

Defined cases: null or empty text has no ids and decodes to no bytes; other columns are ignored; equal rows give equal
rows; an empty table gives no row. A text without any break, of any length, is encoded like others.
"""

from __future__ import annotations

import base64

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

from .common import documents

RANKS = "byte_bpe_50k.tiktoken"
#: A space before white space of any kind or the end.
WIDE_SPACE = regex.compile(r" (?:[\s\x1C-\x1F\x85]|\Z)").search

#: One contraction a word and step. A row knows its id, the next row's id and the next row's position; `gone` is the
#: right half of the pair that merges, whose own next row the merged row takes over.
CONTRACT = """
WITH RECURSIVE step(it, w, pos, id, nid, npos) AS (
  SELECT 0, w, pos, id, nid, npos FROM tokens
  UNION ALL
  (WITH ranked AS (SELECT s.*, m.merged::BIGINT * 2147483648 + s.pos AS k FROM step s LEFT JOIN merges m ON m.l = s.id AND m.r = s.nid),
        best AS (SELECT w, min(k) % 2147483648 AS at, (min(k) // 2147483648)::INTEGER AS merged, arg_min(npos, k) AS gone FROM ranked WHERE k IS NOT NULL GROUP BY w),
        after AS (SELECT r.w, r.nid, r.npos FROM ranked r JOIN best b ON r.w = b.w AND r.pos = b.gone)
   SELECT it + 1, r.w, r.pos, CASE WHEN r.pos = b.at THEN b.merged ELSE r.id END,
          CASE WHEN r.pos = b.at THEN a.nid WHEN r.npos = b.at THEN b.merged ELSE r.nid END,
          CASE WHEN r.pos = b.at THEN a.npos ELSE r.npos END
   FROM ranked r JOIN best b ON r.w = b.w JOIN after a ON a.w = r.w WHERE r.pos <> b.gone)
)
SELECT s.w, s.id FROM step s JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) e ON s.w = e.w AND s.it = e.it ORDER BY s.w, s.pos
"""
SHORT, LONG = 64, 512
#: Pairs of tokens whose meeting is known, at most.
MET = 500_000
#: Rows that the steps of one recursion may hold together.
HELD = 3_000_000
#: A step of all long pieces: places of the least rank (odd ones of a run of overlapping places), what stands around
#: them, whether their contraction makes a pair of lower rank, and the places that wait for such a one.
CONTRACT_LONG = """
WITH RECURSIVE step(it, w, pos, id, nid, npos, k) AS (
  SELECT 0, t.w, t.pos, t.id, t.nid, t.npos, m.merged FROM tokens t LEFT JOIN merges m ON m.l = t.id AND m.r = t.nid
  UNION ALL
  (WITH best AS (SELECT w, min(k) AS k FROM step WHERE it < {steps} GROUP BY w HAVING min(k) IS NOT NULL),
        hits AS (SELECT s.w, s.pos, s.npos AS gone, s.k, lag(s.npos) OVER (PARTITION BY s.w ORDER BY s.pos) IS DISTINCT FROM s.pos AS head
                 FROM step s JOIN best b ON s.w = b.w AND s.k = b.k),
        runs AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY w ORDER BY pos) AS run FROM hits),
        odd AS (SELECT w, pos, gone, k FROM runs QUALIFY row_number() OVER (PARTITION BY w, run ORDER BY pos) % 2 = 1),
        around AS (SELECT o.*, g.nid AS after, g.npos AS next, p.id AS before, coalesce(s.span, 0) AS span
                   FROM odd o JOIN step g ON g.w = o.w AND g.pos = o.gone LEFT JOIN step p ON p.w = o.w AND p.npos = o.pos LEFT JOIN spans s ON s.id = o.k),
        risky AS (SELECT a.*, coalesce(a.span > 0 AND least(x.merged, y.merged, z.merged) < a.k, false) AS bad,
                         a.pos - lag(a.pos) OVER (PARTITION BY a.w ORDER BY a.pos) > 2 * a.span AS apart
                  FROM around a LEFT JOIN merges x ON x.l = a.before AND x.r = a.k LEFT JOIN merges y ON y.l = a.k AND y.r = a.after LEFT JOIN merges z ON z.l = a.k AND z.r = a.k),
        near AS (SELECT *, sum(coalesce(apart, false)::INTEGER) OVER (PARTITION BY w ORDER BY pos) AS part FROM risky),
        taken AS (SELECT w, pos, gone, k, after, next FROM near
                  QUALIFY NOT coalesce(bool_or(bad) OVER (PARTITION BY w, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)),
        moved AS (SELECT r.it + 1 AS it, r.w, r.pos, coalesce(t.k, r.id) AS id, CASE WHEN t.pos IS NULL THEN r.npos ELSE t.next END AS npos, coalesce(n.k, CASE WHEN t.pos IS NULL THEN r.nid ELSE t.after END) AS nid,
                         CASE WHEN t.pos IS NULL AND n.pos IS NULL THEN r.k END AS k, t.pos IS NOT NULL OR n.pos IS NOT NULL AS fresh
                  FROM (SELECT s.*, CASE WHEN s.k IS NOT NULL AND s.k = b.k THEN s.pos END AS own FROM step s JOIN best b ON s.w = b.w) r
                  LEFT JOIN taken t ON t.w = r.w AND t.pos = r.own
                  LEFT JOIN taken n ON n.w = r.w AND n.pos = CASE WHEN t.pos IS NULL THEN r.npos ELSE t.next END
                  WHERE NOT EXISTS (SELECT 1 FROM taken g WHERE g.w = r.w AND g.gone = r.pos))
   SELECT m.it, m.w, m.pos, m.id, m.nid, m.npos, CASE WHEN m.fresh THEN f.merged ELSE m.k END
   FROM moved m LEFT JOIN merges f ON f.l = CASE WHEN m.fresh THEN m.id END AND f.r = m.nid)
)
SELECT s.it, s.w, s.pos, s.id, s.nid, s.npos FROM step s JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) e ON s.w = e.w AND s.it = e.it ORDER BY s.w, s.pos
"""
DECODE = "SELECT d, string_agg(s, '' ORDER BY pos) AS s FROM rows JOIN vocab USING (id) GROUP BY d"


def read_ranks(name: str = RANKS) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def runs(sizes, most: int):
    """(start, end) of runs whose sizes sum to about `most`."""
    start = total = 0
    for i, s in enumerate(sizes):
        total += s
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


class Cache:
    """A dict of two generations of at most `size` entries each; the older one is dropped whole."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set) -> set:
        lack = keys.difference(self.young)
        self.young.update((k, self.old[k]) for k in lack if k in self.old)
        return lack.difference(self.young)

    def trim(self):
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class Codec:
    """The merge table and the vocabulary in an in-memory DuckDB of one thread."""

    def __init__(self, name: str = RANKS, pattern: str = public_tokenizers.PATTERN, squares: int = 1_500_000, cache: int = 400_000):
        ranks = read_ranks(name)
        self.squares, self.find = squares, regex.compile(pattern).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        split = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        l, r, m = (pa.array(x, pa.int32()) for x in zip(*split))
        self.load("merges", pa.table({"l": l, "r": r, "merged": m}))
        # a byte is kept as the character of its number, so that text aggregates can join bytes
        self.load("vocab", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "s": [t.decode("latin-1") for t in ranks]}))
        self.ranks, self.spanned = ranks, False
        self.known = Cache(cache)
        self.token = {i: t for t, i in ranks.items()}
        self.met: dict[tuple[int, int], bool] = {}

    def spans(self):
        """For each token the length of the longest token of lower rank that holds it."""
        if not self.spanned:
            far: dict[int, int] = {}
            for t, i in self.ranks.items():
                for a in range(len(t)):
                    for b in range(a + 2, len(t) + 1):
                        if (k := self.ranks.get(t[a:b], -1)) > i:
                            far[k] = max(far.get(k, 0), len(t))
            self.load("spans", pa.table({"id": pa.array(list(far), pa.int32()), "span": pa.array(list(far.values()), pa.int32())}))
            self.spanned = True

    def load(self, name, table):
        self.con.register("given", table)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def rows(self, words: list[bytes]) -> pa.Table:
        """Token-position rows of the words' bytes."""
        n = np.array([len(w) for w in words])
        ids, ends = self.bytes[np.frombuffer(b"".join(words), np.uint8)], np.cumsum(n)
        last = np.zeros(len(ids), bool)
        last[ends - 1] = True
        pos = (np.arange(len(ids)) - np.repeat(ends - n, n)).astype(np.int32)
        return pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), n), "pos": pos, "id": ids, "nid": pa.array(np.r_[ids[1:], ids[:1]], mask=last), "npos": pa.array(pos + 1, mask=last)})

    def run(self, tokens: pa.Table, sql: str) -> pa.Table:
        self.con.register("tokens", tokens)
        return self.con.sql(sql).to_arrow_table()

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian int32 bytes."""
        got = self.run(self.rows(words), CONTRACT)
        return self.split(got, len(words))

    @staticmethod
    def split(got: pa.Table, n: int) -> list[bytes]:
        w, flat = got["w"].to_numpy(), got["id"].to_numpy().astype("<i4")
        cut = np.searchsorted(w, np.arange(n + 1))
        return [flat[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    def contract_long(self, word: bytes) -> bytes:
        """The same for one long piece: recursions of as many steps as fit, until one ends before its last step."""
        self.spans()
        state = self.rows([word])
        while True:
            steps = max(4, HELD // len(state))
            state = self.run(state, CONTRACT_LONG.format(steps=steps))
            if state["it"][0].as_py() < steps:
                return state["id"].to_numpy().astype("<i4").tobytes()
            state = state.drop_columns("it")

    def contract_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are slices or short, each by the recursion for its length."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for s, e in runs([len(words[i]) ** 2 for i in short], self.squares):
            for i, ids in zip(short[s:e], self.contract([words[i] for i in short[s:e]])):
                out[i] = ids
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.contract_long(w)
        return out

    def meet(self, pairs: set[tuple[int, int]]) -> None:
        """Learn of pairs of tokens whether both stay when they are contracted together."""
        if len(self.met) > MET:
            self.met = {}
        new = list(pairs.difference(self.met))
        got = self.contract_all([self.token[a] + self.token[b] for a, b in new])
        self.met.update((p, ids == np.array(p, "<i4").tobytes()) for p, ids in zip(new, got))

    def contract_sliced(self, word: bytes, width: int = SHORT) -> bytes:
        """The same for a piece of any length."""
        half = width // 2
        slices = [(a, min(a + width, len(word))) for a in range(0, max(len(word) - half, 1), half)]
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}  # ids and their starts, and the end, in a slice
        while True:
            new = list({word[a:b] for a, b in slices}.difference(known))
            for w, raw in zip(new, self.contract_all(new)):
                ids = np.frombuffer(raw, "<i4")
                known[w] = ids, np.cumsum([0, *(len(self.token[i]) for i in ids.tolist())])
            got = [known[word[a:b]] for a, b in slices]
            # places where two neighbours both cut, with the tokens that would meet there
            places = []
            for (a, b), (c, _), (left, at), (right, to) in zip(slices, slices[1:], got, got[1:]):
                cuts = np.intersect1d(at[np.searchsorted(at, c - a) : -1], to[: np.searchsorted(to, b - c)] + c - a, assume_unique=True)
                cuts = cuts[cuts > 0]
                x, y = left[np.searchsorted(at, cuts) - 1], right[np.searchsorted(to, cuts + a - c)]
                places.append(list(zip((cuts + a).tolist(), zip(x.tolist(), y.tolist()))))
            self.meet({p for found in places for _, p in found})
            cut = [next((at for at, p in found if self.met[p]), None) for found in places]
            if None not in cut:
                break
            joined, i = [], 0
            while i < len(slices):
                apart = i == len(cut) or cut[i] is not None
                joined.append(slices[i] if apart else (slices[i][0], slices[i + 1][1]))
                i += 1 if apart else 2
            slices = joined
        edges = [0, *cut, len(word)]
        return b"".join(ids[np.searchsorted(at, s - a) : np.searchsorted(at, e - a)].tobytes() for (a, _), (ids, at), s, e in zip(slices, got, edges, edges[1:]))

    def learn(self, chunks: set[str]):
        """Fill the cache for these chunks of text; a piece is a chunk of one piece, so both share it."""
        known = self.known
        new = {c: self.find(c) for c in known.missing(chunks)}
        words = sorted(known.missing(set().union(*new.values())))
        raw = [w.encode() for w in words]
        short = [i for i, w in enumerate(raw) if len(w) <= SHORT]
        for s, e in runs([len(raw[i]) ** 2 for i in short], self.squares):
            known.young.update(zip((words[i] for i in short[s:e]), self.contract([raw[i] for i in short[s:e]])))
        known.young.update((words[i], self.contract_sliced(w)) for i, w in enumerate(raw) if len(w) > SHORT)
        got = known.young.__getitem__
        known.young.update([(c, b"".join(map(got, ps))) for c, ps in new.items() if len(ps) != 1])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian int32 bytes."""
        parts = []
        for t in texts:
            # the pattern never joins what stands on both sides of a space that another character than white space
            # follows, so such chunks are encoded by themselves; texts with other runs of white space stay whole
            if WIDE_SPACE(t):
                parts.append([t])
            else:
                p = t.split(" ")
                p[1:] = [" " + x for x in p[1:]]
                parts.append(p)
        self.learn(set().union(*parts))
        got = self.known.young.__getitem__
        out = [b"".join(map(got, p)) for p in parts]
        self.known.trim()
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        n = np.array([len(x) for x in ids], np.int64)
        if not n.sum():
            return [b""] * len(ids)
        flat = np.concatenate(ids).astype(np.int32)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        self.con.register("rows", pa.table({"d": np.repeat(np.arange(len(ids)), n), "pos": pos, "id": flat}))
        got = self.con.sql(DECODE).to_arrow_table()
        out = [b""] * len(ids)
        for d, s in zip(got["d"].to_pylist(), got["s"].to_pylist()):
            out[d] = s.encode("latin-1")
        return out


_codecs: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """The worker's codec: made once, kept with its caches for the tasks that follow."""
    if name not in _codecs:
        _codecs[name] = Codec(name)
    return _codecs[name]


def encode(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """(doc_id, ids) of each row's whole text."""

    def each(batches):
        c = codec(name)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for s, e in runs([len(t) + 1 for t in texts], 2_000_000):
                got = c.encode(texts[s:e])
                off = np.r_[0, np.cumsum([len(x) // 4 for x in got])].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(got), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = RANKS) -> DataFrame:
    """encoded(doc_id, ids) -> (doc_id, ids, decoded) with the bytes that the ids stand for."""

    def each(batches):
        c = codec(name)
        for b in batches:
            lists = b.column(1)
            n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            for s, e in runs((n + 1).tolist(), 500_000):
                part = lists.slice(s, e - s)
                flat, cut = part.flatten().to_numpy(), np.cumsum(n[s:e])[:-1]
                out = c.decode(np.split(flat, cut))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), part, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(each, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """(doc_id, ids, decoded) of each row's whole text: encode() and decode() in one pass of one worker."""

    def each(batches):
        c = codec(name)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for s, e in runs([len(t) + 1 for t in texts], 2_000_000):
                got = [np.frombuffer(x, "<i4") for x in c.encode(texts[s:e])]
                off = np.r_[0, np.cumsum([len(x) for x in got])].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(got)))
                out = [d for i, j in runs([len(x) + 1 for x in got], 500_000) for d in c.decode(got[i:j])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), ids, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, ids array<int>, decoded binary")


def op2(spark, sf_dir: str) -> DataFrame:
    d = round_trip(documents(spark, sf_dir))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
