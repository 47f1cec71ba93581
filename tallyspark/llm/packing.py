"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Each document's ids, with its end id, are cut into whole windows and, what is left, into pieces of at most ``grain``
ids: the finer the pieces, the less padding (at 2048: 2 %, at 256: 0.4 %). The pieces, without their ids, are dealt to
groups of about ``windows`` windows by a hash of their row number, so that groups are even whatever the documents are. In a group, partial partitions of as many sums as there are windows are merged, the two of largest spread first,
the largest sums of one on the smallest of the other, until one partition is left. Its windows are near-equal; if the
largest exceeds the capacity, the number of windows rises and the differencing starts anew.

Defined cases: null or empty text is one piece that holds the end id; null doc_ids are packed like others; rows of equal
ids are packed one by one; extra columns are ignored; an empty table gives no row. The strings of special tokens are
ordinary text.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import runs
from .common import documents, stage

VOCAB, CAPACITY, GRAIN, END = "word_bpe_49k.json", 2048, 256, 1
PIECES = "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


# The tokenizer's own rules for words of Latin-1 letters, which are composed and in lower case: how it splits them and the
# letters that stand for bytes.
LATIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\xfe]+")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)}.difference(SHOWN)))}
LETTERS = str.maketrans({chr(i): "".join(BYTES[b] for b in chr(i).encode()) for i in range(128, 256)})


class Words(dict):
    """Ids, as little-endian uint32 bytes, of words by a tokenizer that never joins what white space separates.

    Words are kept in two generations of at most `size` each; the older one is dropped whole. The model lower-cases, so
    words are looked up in lower case. Words of Latin-1 letters are split here and their parts looked up or given to the
    model by itself, without the tokenizer's passes before it, which take most of its time; all others take the whole way.
    """

    def __init__(self, name: str = VOCAB, size: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(public_tokenizers.path(name))
        self.model.encode_special_tokens = True
        self.size, self.old, self.parts = size, {}, {}

    def latin(self, word: str) -> bytes:
        """Ids of a word of Latin-1 letters, by its parts."""
        out, parts, tokenize = [], self.parts, self.model.model.tokenize
        for p in PARTS.findall(word.lower()):
            ids = parts.get(p)
            if ids is None:
                ids = parts[p] = array("I", [t.id for t in tokenize(p if p.isascii() else p.translate(LETTERS))]).tobytes()
            out.append(ids)
        return b"".join(out)

    def learn(self, words: set[bytes]) -> None:
        """Take in the ids of words: from the older generation, or from the model, many words a call."""
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        lack = words.difference(self)
        self.update((w, self.old[w]) for w in lack if w in self.old)
        if len(self.parts) >= self.size // 2:
            self.parts = {}
        new = []
        for w in lack.difference(self):
            word = w.decode()
            if LATIN.fullmatch(word):
                self[w] = self.latin(word)
            else:
                new.append(w)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            got = self.model.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
            ids, cut = np.array(got.ids, "<u4"), np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(part) + 1)).tolist()
            self.update((w, ids[a:b].tobytes()) for w, a, b in zip(part, cut, cut[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian uint32 bytes."""
        words = [t.encode().lower().split() for t in texts]
        self.learn(set().union(*words))
        return [b"".join(map(self.__getitem__, w)) for w in words]


def cuts(n: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """Where the pieces of n ids start, and n."""
    whole = n - n % capacity
    return [*range(0, whole, capacity), *range(whole, n, grain), n]


_words: dict[str, Words] = {}


def pieces(docs: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN, end: int = END, name: str = VOCAB, with_ids: bool = False) -> DataFrame:
    """(piece, doc_id, start, length, ids_crc32, doc_tokens, ids): the cut documents, numbered; ids only if asked for."""
    tail = np.array([end], "<u4").tobytes()

    def each(batches):
        if name not in _words:
            _words[name] = Words(name)
        at_piece = TaskContext.get().partitionId() << 40
        for b in batches:
            texts, docs = [t or "" for t in b.column(1).to_pylist()], b.column(0)
            for s, e in runs([len(t) + 1 for t in texts], 4_000_000):
                rows = []
                for i, ids in enumerate(_words[name].encode(texts[s:e]), s):
                    ids += tail
                    at = cuts(len(ids) // 4, capacity, grain)
                    for k, m in zip(at, at[1:]):
                        p = ids[4 * k : 4 * m]
                        rows.append((i, k, m - k, zlib.crc32(p), at[-1], p if with_ids else None))
                row, *cols = zip(*rows)
                number = pa.array(np.arange(at_piece, at_piece + len(rows)))
                at_piece += len(rows)
                yield pa.RecordBatch.from_arrays([number, docs.take(pa.array(row)), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, PIECES)


def difference(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece by multiway differencing."""
    # a partial partition: its sums, negated, in rising order and, for each sum, a node of the tree of what it holds
    parts, tree = {}, [(-1, -1)] * len(lengths)
    heap = [(-int(n), i) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    nxt = len(lengths)

    def whole(i):
        if i not in parts:
            sums, held = np.zeros(windows, np.int64), np.full(windows, -1)
            sums[0], held[0] = -lengths[i], i
            return sums, held
        return parts.pop(i)

    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        if a not in parts:
            a, b = b, a
        sums, held = whole(a)
        if b not in parts:  # a single piece goes on the smallest sum, which then moves up to its place
            x, node = sums[-1] - lengths[b], b
            if held[-1] >= 0:
                node = len(tree)
                tree.append((int(held[-1]), b))
            k = int(np.searchsorted(sums[:-1], x, side="right"))
            sums[k + 1 :], held[k + 1 :] = sums[k:-1], held[k:-1]
            sums[k], held[k] = x, node
        else:
            sb, hb = whole(b)
            sums, other = sums + sb[::-1], hb[::-1]
            new = np.where(held < 0, other, held)
            for k in np.flatnonzero((held >= 0) & (other >= 0)):
                new[k] = len(tree)
                tree.append((int(held[k]), int(other[k])))
            order = np.argsort(sums, kind="stable")
            sums, held = sums[order], new[order]
        parts[nxt] = (sums, held)
        heapq.heappush(heap, (int(sums[0] - sums[-1]), nxt))
        nxt += 1
    window = np.zeros(len(lengths), np.int64)
    for w, node in enumerate(whole(heap[0][1])[1]):
        todo = [int(node)] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < len(lengths):
                window[x] = w
            else:
                todo += tree[x]
    return window


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece, of as few near-equal windows as differencing fits into the capacity."""
    window, full = np.full(len(lengths), -1), lengths >= capacity
    window[full] = np.arange(full.sum())
    rest = lengths[~full]
    if len(rest):
        n = -(-int(rest.sum()) // capacity)
        while True:
            got = difference(rest, n)
            if np.bincount(got, rest).max() <= capacity:
                break
            n += 1
        window[~full] = got + full.sum()
    return window


def pack(cut: DataFrame, capacity: int = CAPACITY, windows: int = 256) -> DataFrame:
    """cut: a stage table of pieces -> the same with sequence_id and offset, gapless from 0 in each sequence."""
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (windows * capacity)))
    rest = [c for c in cut.columns if c not in ("piece", "sequence_id", "offset")]
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("piece"), F.lit(groups)))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece").reset_index(drop=True)
        w = pack_group(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = int(pdf["_group"].iloc[0]) * (1 << 24) + w
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf[[*rest, "sequence_id", "offset"]]

    schema = ", ".join(f"{n} {t}" for n, t in cut.select(*rest).dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInPandas(each, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    return pack(stage(pieces(documents(spark, sf_dir)).drop("ids"), "pieces"))
