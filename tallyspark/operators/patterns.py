"""Many patterns in many texts: each text is read once, however many patterns there are.

Patterns up to HELD letters in all, counted first, go to the tasks as one Arrow table, for one automaton over all of them. Of
more patterns the tasks hold a bitmap of BITS bits, of hashes of their first letters and of their first and last letters
with their length. Parts of texts that pass it, few unless they are patterns, are joined with the patterns by equality, which
decides. No whole text is shuffled.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Letters of patterns that a task holds at once.
HELD = 2_000_000
#: Bits of the bitmap, as a power of two (16 MB), letters of texts that are looked at together, and the longest hashed ends.
BITS, LETTERS, ENDS = 27, 1_000_000, 32
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Automaton:
    """Ids of patterns by text; `alone`: no letter a-z or digit may stand on either side."""

    def __init__(self, patterns: Iterable[tuple[int, str]], alone: bool):
        import ahocorasick

        self.alone, self.found = alone, ahocorasick.Automaton(ahocorasick.STORE_INTS)
        # a pattern's number in the automaton -> its length and first id; the other ids of a pattern that occurs again
        self.sizes, self.first, self.more = array("q"), array("q"), {}
        for i, p in patterns:
            k = self.found.get(p, -1) if p else None
            if k == -1:
                self.found.add_word(p, len(self.first))
                self.sizes.append(len(p))
                self.first.append(i)
            elif k is not None:
                self.more.setdefault(k, []).append(i)
        self.empty = not self.first
        self.found.make_automaton()

    @staticmethod
    def _joins(c: str) -> bool:
        return "a" <= c <= "z" or "0" <= c <= "9"

    def search(self, text: str) -> set[int]:
        out: set[int] = set()
        if self.empty:
            return out
        for end, k in self.found.iter(text):
            n = self.sizes[k]
            if self.alone and (end >= n and self._joins(text[end - n]) or end + 1 < len(text) and self._joins(text[end + 1])):
                continue
            out.add(self.first[k])
            out.update(self.more.get(k, ()))
        return out


def _packed(patterns: DataFrame, normal: Callable[[str], str]) -> pa.Table:
    """patterns(pattern_id, pattern) as one Arrow table of normal patterns: objects live for a slice at a time only."""
    own = patterns.toArrow()
    slices = [pa.record_batch([b.column(0), pa.array([normal(x) for x in b.column(1).to_pylist()], pa.string())], ["id", "pattern"]) for b in own.to_batches(max_chunksize=10_000)]
    return pa.Table.from_batches(slices, pa.schema([("id", pa.int64()), ("pattern", pa.string())]))


def _pairs(packed: pa.Table) -> Iterator[tuple[int, str]]:
    for b in packed.to_batches(max_chunksize=10_000):
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())


def find(rows: DataFrame, key: str, fields: list[str], patterns: DataFrame, alone: bool = False, normal: Callable[[str], str] = str.lower, held: int | None = None) -> DataFrame:
    """(key, field, pattern_id): which of patterns(pattern_id, pattern) stand in which fields of rows; `normal` makes patterns
    and texts comparable. An empty or null pattern, and a null text, is found nowhere."""
    held = HELD if held is None else held
    own = patterns.where("pattern <> ''").select(F.col("pattern_id").cast("long").alias("pattern_id"), "pattern").distinct()
    letters = own.agg(F.sum(F.length("pattern"))).first()[0] or 0
    given = rows.select(F.col(key).cast("long").alias(key), *fields)
    schema = f"{key} long, field string, pattern_id long"

    def searched(some: pa.Table) -> DataFrame:
        def each(batches):
            machine = Automaton(_pairs(some), alone)
            for b in batches:
                ids = b.column(0).to_pylist()
                for f, column in zip(fields, b.columns[1:]):
                    hits = [(i, x) for i, t in zip(ids, column.to_pylist()) if t is not None for x in sorted(machine.search(normal(t)))]
                    got, found = zip(*hits) if hits else ((), ())
                    yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array([f] * len(got), pa.string()), pa.array(found, pa.int64())], [key, "field", "pattern_id"])

        return given.mapInArrow(each, schema)

    if letters <= held:
        return searched(_packed(own, normal))
    return _joined(given, key, fields, own, alone, normal)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[0]
    return x ^ (x >> np.uint64(29))


def _levels(letters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of the n letters from each place on), for n of 1, 2, 4 to ENDS."""
    n, h = 1, _mix(letters.astype(np.uint64) + np.uint64(1))
    while True:
        yield n, h
        if 2 * n > ENDS or len(h) <= n:
            return
        n, h = 2 * n, _mix(h[:-n] * MIX[1] + h[n:])


def _end(length: int) -> int:
    """How many letters of a pattern's start and end are hashed: the two cover it up to twice ENDS letters."""
    return min(ENDS, 1 << (length.bit_length() - 1))


def _both(h: np.ndarray, at: np.ndarray, end: int, length) -> np.ndarray:
    return _mix(h[at] * MIX[2] + h[at + (length - end)] + np.asarray(length).astype(np.uint64))


def _bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _bits(patterns: Iterable[str]) -> list[int]:
    """The bits of patterns in the bitmap."""
    some = list(patterns)
    sizes = np.array([len(p) for p in some], np.int64)
    starts, of, out = np.cumsum(sizes) - sizes, np.array([_end(len(p)) for p in some]), [np.zeros(0, np.int64)]
    for end, h in _levels(_codes("".join(some))):
        at, length = starts[of == end], sizes[of == end]
        out += _bit(h[at]), _bit(_both(h, at, end, length))
    return np.unique(np.concatenate(out)).tolist()


def _pieces(texts: list[str], longest: int) -> Iterator[list[tuple[int, str, int]]]:
    """Lists of (text, piece, first place) of about LETTERS letters: a piece holds one letter before its first place and as many
    behind its LETTERS letters as a pattern has."""
    some, size = [], 0
    for i, t in enumerate(texts):
        for s in range(0, len(t), LETTERS):
            before = min(s, 1)
            some.append((i, t[s - before : s + LETTERS + longest], before))
            size += len(some[-1][1])
            if size >= LETTERS:
                yield some
                some, size = [], 0
    if some:
        yield some


def _candidates(texts: list[str], bitmap: np.ndarray, lengths: dict[int, list[int]], alone: bool) -> set[tuple[int, str]]:
    """(text, part): the parts of texts that pass the bitmap; lengths: those of patterns, by their _end()."""
    has = lambda b: (bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
    out: set[tuple[int, str]] = set()
    for some in _pieces(texts, max(map(max, lengths.values()))):
        line = "\x00".join(x for _, x, _ in some) + "\x00"
        letters, sizes = _codes(line), np.array([len(x) for _, x, _ in some])
        ends = np.cumsum(sizes + 1) - 1
        first = ends - sizes + np.array([b for _, _, b in some])
        joins = (letters >= 97) & (letters <= 122) | (letters >= 48) & (letters <= 57)
        for end, h in _levels(letters):
            if end not in lengths:
                continue
            start = has(_bit(h))
            if alone:
                start[1:] &= ~joins[: len(h) - 1]
            start = np.flatnonzero(start)
            piece = np.searchsorted(ends, start, side="right")
            inside = piece < len(ends)
            start, piece = start[inside], piece[inside]
            for n in lengths[end]:
                ok = (start >= first[piece]) & (start + n <= ends[piece])
                at, of = start[ok], piece[ok]
                ok = has(_bit(_both(h, at, end, n)))
                if alone:
                    ok &= ~joins[at + n]
                out.update((some[k][0], line[a : a + n]) for a, k in zip(at[ok].tolist(), of[ok].tolist()))
    return out


def _joined(given: DataFrame, key: str, fields: list[str], own: DataFrame, alone: bool, normal: Callable[[str], str]) -> DataFrame:
    """find() for any number of patterns."""

    def normalized(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([normal(x) for x in b.column(1).to_pylist()], pa.string())], ["pattern_id", "part"])

    def bits(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bits(b.column(0).to_pylist()), pa.int64())], ["bit"])

    named = own.mapInArrow(normalized, "pattern_id long, part string").where("part <> ''").distinct()
    sizes = [r.n for r in named.select(F.length("part").alias("n")).distinct().collect()]
    lengths: dict[int, list[int]] = {}
    for n in sizes:
        lengths.setdefault(_end(n), []).append(n)
    one = F.col("bit") + 1
    rows = named.select("part").mapInArrow(bits, "bit long").groupBy(F.bitmap_bucket_number(one).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits")).collect()
    bitmap = np.zeros((1 << BITS) // 8, np.uint8)
    for r in rows:
        bitmap[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)

    def each(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            ids = b.column(0).to_pylist()
            for f, column in zip(fields, b.columns[1:]):
                texts = [normal(t) if t else "" for t in column.to_pylist()]
                got = sorted(_candidates(texts, bitmap, lengths, alone)) if lengths else []
                where = [i for i, _ in got]
                yield pa.RecordBatch.from_arrays([pa.array([row + i for i in where], pa.int64()), pa.array([ids[i] for i in where], pa.int64()), pa.array([f] * len(got), pa.string()), pa.array([x for _, x in got], pa.string())], ["row", key, "field", "part"])
            row += len(ids)

    some = given.mapInArrow(each, f"row long, {key} long, field string, part string")
    return some.join(named, "part").select("row", key, "field", "pattern_id").distinct().drop("row")
