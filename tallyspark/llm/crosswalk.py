"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another, and how often.

A text is encoded by A (byte-level pairs, of a space and the text) and by B (pieces, which adds the space itself). Where
tokens of both end at the same byte the text is cut; what lies between two cuts is a group, and every A token of a group
is linked with every B token of it. Neither tokenizer joins anything across a space or line end that follows and precedes
other signs than white space, so texts are cut there into words, and each word is encoded and aligned once: token ends
by cumsum, common cuts by intersect1d, group labels by searchsorted, links by repeat-based expansion over the ids of a
group with their numbers. A text in which the bytes of a word differ is encoded and compared whole.

``encode`` writes a row for each run of texts: what each text holds, its words, and the run's distinct id pairs with the
number of its documents that hold them. ``pair_counts`` sums these, first by (pair, salt), then by pair. ``scored`` joins
the sums back to the runs' pairs, and each run with its sums gives the rows of its documents: no row for each link or
text is ever shuffled. ``document_links`` lists the id pairs of each document.

Defined cases: null or empty text, and one whose joined bytes of A or B differ from a space and the text (it holds U+2581,
which B takes for a space), has no token: zeros and ''; rows of equal ids count one by one; extra columns are ignored; an
empty table gives no row. The strings of special tokens are ordinary text.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import runs
from .common import documents, stage

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Letters of text in a run, words that are kept, and links that are expanded at once.
RUN, KEPT, EXPANDED = 6_000_000, 150_000, 2_000_000
SALTS = 16
_regular = re.compile(r"\n?\S+")
_cut = re.compile(r"(?<=\S)(?=[ \n]\S)")

RUNS = """run long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>,
 a array<int>, b array<int>, n_docs array<int>, n_words binary, word binary, occurs binary, n_pairs binary, pair binary, times binary"""
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: visible bytes stand for themselves, the rest follow from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


def expand(ga: np.ndarray, ids_a: np.ndarray, gb: np.ndarray, ids_b: np.ndarray, n: int):
    """Links of groups 0 .. n-1 -> slices of (group, a, b, times); ga, gb: the group of each token, rising."""

    def counted(g, ids):
        key, times = np.unique(g.astype(np.int64) << 32 | ids, return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, times

    (ka, a, ta), (kb, b, tb) = counted(ga, ids_a), counted(gb, ids_b)
    first = np.searchsorted(kb, np.arange(n + 1))
    width = np.diff(first)[ka]  # how many of B each of A meets
    for s, e in runs(width.tolist(), EXPANDED):
        w = width[s:e]
        left = np.repeat(np.arange(s, e), w)
        right = np.repeat(first[ka[s:e]] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        yield ka[left], a[left], b[right], ta[left] * tb[right]


class Aligner:
    """Words, aligned once. When there are more than KEPT before a run, those met once are dropped, and the rest too if
    they are more than half of KEPT."""

    def __init__(self, a: str = BYTES, b: str = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(a))
        self.a.encode_special_tokens = True
        letters, vocab = byte_letters(), self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path(b))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if bad := [p for p in pieces if "▁" in p.lstrip("▁") or "\n" in p]:
            raise ValueError(f"pieces reach across words: {bad[:5]}")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.clear()

    def clear(self) -> None:
        """code: place of each word, -1 for what is no word, -2 for one whose bytes differ; uses: how often each was met."""
        self.code, self.texts, self.counts, self.uses = {}, [], np.zeros((4, 0), np.int64), np.zeros(0, np.int64)
        self.n_pairs, self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def trim(self) -> None:
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > KEPT // 2:
            return self.clear()
        place = np.full(len(self.uses), -1)
        place[keep] = np.arange(len(keep))
        self.code = {w: k for w, c in self.code.items() if c >= 0 and (k := int(place[c])) >= 0}
        self.texts = [self.texts[k] for k in keep.tolist()]
        at = self.places(keep)
        self.pair, self.times, self.n_pairs = self.pair[at], self.times[at], self.n_pairs[keep]
        self.counts, self.uses = self.counts[:, keep], self.uses[keep] * 0

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Where the pairs of the words of these codes stand."""
        n = self.n_pairs[codes]
        return np.repeat((np.cumsum(self.n_pairs) - self.n_pairs)[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def ids(self, words: list[str]):
        """(bytes' text, A's ids, B's ids, tokens of A in each word, of B) of words: "x" is of " x", a line end and x of itself,
        a space and x of x."""
        plain = [w[1:] if w[0] == " " else w if w[0] == "\n" else f" {w}" for w in words]
        got = self.a.encode(plain, is_pretokenized=True, add_special_tokens=False)
        na = np.bincount(np.array(got.word_ids, np.int64), minlength=len(words))
        # B adds a space of its own, which what starts with a line end doesn't have
        lists = self.b.encode([p[1:] if p[0] == " " else p for p in plain], num_threads=1)
        lists = [x[1:] if p[0] == "\n" else x for p, x in zip(plain, lists)]
        return plain, np.array(got.ids, np.int64), np.fromiter(chain.from_iterable(lists), np.int64), na, np.array([len(x) for x in lists])

    def learn(self, words: list[str]) -> None:
        for s, e in runs([len(w) + 8 for w in words], 400_000):
            self._learn(words[s:e])

    def _learn(self, words: list[str]) -> None:
        plain, a, b, na, nb = self.ids(words)
        raw = [w.encode() for w in plain]
        if (got := b"".join(map(self.bytes_a.__getitem__, a.tolist()))) != (want := b"".join(raw)) or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != want or len(got) != len(want):
            at_a, at_b, good = np.r_[0, np.cumsum(na)], np.r_[0, np.cumsum(nb)], []
            for k, w in enumerate(raw):
                mine = (b"".join(map(t.__getitem__, i[at[k] : at[k + 1]].tolist())) for t, i, at in ((self.bytes_a, a, at_a), (self.bytes_b, b, at_b)))
                if all(x == w for x in mine):
                    good.append(k)
                else:
                    self.code[words[k]] = -2
            if good:
                self._learn([words[k] for k in good])
            return
        # all words as one text: a word's end is an end of tokens of both
        ends_a, ends_b, ends = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), np.cumsum([len(w) for w in raw])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ga, gb, word = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), np.searchsorted(ends, cuts)
        in_a, in_b = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
        n_links = np.bincount(word, in_a * in_b, len(words)).astype(np.int64)
        keys, times = [], []
        for g, x, y, t in expand(ga, a, gb, b, len(cuts)):
            k, at = np.unique(word[g] << 32 | x << 16 | y, return_inverse=True)
            keys.append(k)
            times.append(np.bincount(at, t, len(k)).astype(np.int64))
        key, at = np.unique(np.concatenate(keys), return_inverse=True)  # slices may share a word
        self.n_pairs = np.r_[self.n_pairs, np.bincount(key >> 32, minlength=len(words))]
        self.pair = np.r_[self.pair, key & 0xFFFFFFFF]
        self.times = np.r_[self.times, np.bincount(at, np.concatenate(times), len(key)).astype(np.int64)]
        self.uses = np.r_[self.uses, np.zeros(len(words), np.int64)]
        self.counts = np.c_[self.counts, [na, nb, np.bincount(word, minlength=len(words)), n_links]]
        self._name(a, b, ga, gb, in_a, in_b, word, len(words))
        at = len(self.texts) - len(words)
        self.code.update(zip(words, range(at, at + len(words))))

    def _name(self, a, b, ga, gb, in_a, in_b, word, n) -> None:
        """The written groups of each word: A's ids | B's ids, groups parted by ;"""
        to_a, to_b = np.cumsum(in_a), np.cumsum(in_b)
        place_a = np.arange(len(a)) + (to_b - in_b)[ga]
        place_b = np.arange(len(b)) + to_a[gb]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[to_a - 1]], mark[place_b[to_b - 1]] = ord("|"), ord(";")
        parts = [""] * (2 * len(ids))
        parts[::2], parts[1::2] = map(str, ids.tolist()), mark.tobytes().decode()
        stop = (to_a + to_b)[np.flatnonzero(np.r_[word[1:] != word[:-1], True])] * 2
        self.texts += ["".join(parts[i : j - 1]) for i, j in zip([0, *stop.tolist()], stop.tolist())]
        assert len(stop) == n

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        """The codes of the words of each text, all of them aligned; none where a text has no token."""
        split = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(self.code)
        odd = [w for w in new if not _regular.fullmatch(w)]
        self.code.update(dict.fromkeys(odd, -1))
        self.learn(list(new.difference(odd)))
        out = []
        for t, w in zip(texts, split):
            got = np.array(list(map(self.code.__getitem__, w)), np.int64)
            least = got.min(initial=0)
            if least == -1:  # runs of white space, or at an end
                chunks = _cut.split(f" {t}")
                w = [c[1:] if c[0] == " " and c[1:2] != "\n" and _regular.fullmatch(c, 1) else c if _regular.fullmatch(c) else f" {c}" for c in chunks]
                self.learn(list(set(w).difference(self.code)))
                got = np.array(list(map(self.code.__getitem__, w)), np.int64)
                least = got.min()
            if least == -2:
                whole = f"  {t}"
                self.learn([whole])
                got = np.array([self.code[whole]])
                if got[0] == -2:
                    del self.code[whole]
                    got = got[:0]
            out.append(got)
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def _packed(x: np.ndarray) -> bytes:
    raw = x.astype("<i4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True), "<i4").astype(np.int64)


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of n values."""
    total = np.r_[0, np.cumsum(values)]
    end = np.cumsum(n)
    return total[end] - total[end - n]


def _run(m: Aligner, number: int, doc_ids: list, texts: list[str]) -> dict:
    """A row of RUNS."""
    if len(m.code) > KEPT:
        m.trim()
    codes = m.codes(texts)
    names = [hashlib.sha256(";".join([m.texts[c] for c in x.tolist()]).encode()).hexdigest() if len(x) else "" for x in codes]
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in codes])
    flat = np.concatenate([*codes, np.zeros(0, np.int64)])
    totals = [np.bincount(doc, c[flat], len(texts)).astype(np.int64).tolist() for c in m.counts]
    met = np.bincount(flat, minlength=len(m.uses))
    m.uses += met
    used = np.flatnonzero(met)  # the run's own list of words
    local = np.zeros(len(met), np.int64)
    local[used] = np.arange(len(used))
    key, occurs = np.unique(doc * max(len(used), 1) + local[flat], return_counts=True)
    doc, word = np.divmod(key, max(len(used), 1))
    # the pairs of the words used, as places in the run's list of pairs
    at = m.places(used)
    pairs, pair = np.unique(m.pair[at], return_inverse=True)
    n_pairs, first = m.n_pairs[used], np.cumsum(m.n_pairs[used]) - m.n_pairs[used]
    n_docs = np.zeros(len(pairs), np.int64)
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    for s, e in runs(_sums(n_pairs[word], np.diff(edge)).tolist(), EXPANDED):
        w = word[edge[s] : edge[e]]
        n = n_pairs[w]
        held = pair[np.repeat(first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        once = np.sort(np.repeat(doc[edge[s] : edge[e]], n) * len(pairs) + held)
        n_docs += np.bincount(once[np.r_[True, once[1:] != once[:-1]][: len(once)]] % max(len(pairs), 1), minlength=len(pairs))
    n_words = np.bincount(doc, minlength=len(texts))
    row = {"run": number, "doc_id": doc_ids} | dict(zip(("n_a", "n_b", "n_groups", "n_links"), totals)) | {"groups_sha256": names, "a": pairs >> 16, "b": pairs & 0xFFFF, "n_docs": n_docs}
    return row | {k: _packed(v) for k, v in (("n_words", n_words), ("word", word), ("occurs", occurs), ("n_pairs", n_pairs), ("pair", pair), ("times", m.times[at]))}


_run_type = pa.schema(
    [("run", pa.int64()), *((k, pa.list_(pa.int64())) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.list_(pa.string()))]
    + [(k, pa.list_(pa.int32())) for k in ("a", "b", "n_docs")] + [(k, pa.binary()) for k in ("n_words", "word", "occurs", "n_pairs", "pair", "times")]
)


def encode(docs: DataFrame, a: str = BYTES, b: str = PIECES) -> DataFrame:
    """A row of RUNS for every run of texts, written to the shared folder."""

    def each(batches):
        if (a, b) not in _aligners:
            _aligners[a, b] = Aligner(a, b)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for s, e in runs([len(t) + 1 for t in texts], RUN):
                row = _run(_aligners[a, b], number, ids[s:e], texts[s:e])
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _run_type], schema=_run_type)
                number += 1

    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, RUNS), "crosswalk")


def run_pairs(encoded: DataFrame) -> DataFrame:
    """(run, place, a, b, n_docs)"""
    pairs = encoded.select("run", F.posexplode(F.arrays_zip("a", "b", "n_docs")).alias("place", "x"))
    return pairs.select("run", "place", "x.a", "x.b", F.col("x.n_docs").cast("long").alias("n_docs"))


def pair_counts(encoded: DataFrame, salts: int = SALTS) -> DataFrame:
    """(a, b, count, best): in how many documents each id pair is linked, and whether no pair of its A id is in more."""
    salted = run_pairs(encoded).groupBy("a", "b", F.pmod(F.col("run"), F.lit(salts)).alias("salt")).agg(F.sum("n_docs").alias("n"))
    counts = stage(salted.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    top = counts.groupBy(F.col("a").alias("_a")).agg(F.max("count").alias("_top"))
    return counts.join(top, F.col("a") == F.col("_a")).select("a", "b", "count", (F.col("count") == F.col("_top")).alias("best"))


def _score(run: pa.Table, sums: pa.Table) -> pa.Table:
    row = {k: run.column(k)[0] for k in run.column_names}
    x = {k: _unpacked(row[k].as_py()) for k in ("n_words", "word", "occurs", "n_pairs", "pair", "times")}
    count, best = np.zeros(sums.num_rows, np.int64), np.zeros(sums.num_rows, np.int64)
    place = sums.column("place").to_numpy()
    count[place], best[place] = sums.column("count").to_numpy(), sums.column("best").to_numpy()
    out = [_sums(x["occurs"] * _sums(x["times"] * v[x["pair"]], x["n_pairs"])[x["word"]], x["n_words"]) for v in (best, count)]
    cols = {k: row[k].values for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | dict(zip(("n_best", "count_sum"), map(pa.array, out)))
    return pa.table(cols | {"groups_sha256": row["groups_sha256"].values})


def scored(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)"""
    mine = run_pairs(encoded).drop("n_docs").join(counts, ["a", "b"]).select("run", "place", "count", F.col("best").cast("int").alias("best"))
    whole = encoded.drop("a", "b", "n_docs").withColumnRenamed("run", "_run")
    return whole.groupBy("_run").cogroup(mine.groupBy("run")).applyInArrow(_score, ROWS)


def document_links(encoded: DataFrame) -> DataFrame:
    """(doc_id, a, b, times): the id pairs of each document and how many pairs of its tokens are linked."""

    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = {k: _unpacked(row[k]) for k in ("n_words", "word", "occurs", "n_pairs", "pair", "times")}
                first, at, a, b = np.cumsum(x["n_pairs"]) - x["n_pairs"], np.r_[0, np.cumsum(x["n_words"])], np.array(row["a"]), np.array(row["b"])
                for k, doc_id in enumerate(row["doc_id"]):
                    w, o = x["word"][at[k] : at[k + 1]], x["occurs"][at[k] : at[k + 1]]
                    n = x["n_pairs"][w]
                    take = np.repeat(first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    pair, back = np.unique(x["pair"][take], return_inverse=True)
                    times = np.bincount(back, x["times"][take] * np.repeat(o, n), len(pair)).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id] * len(pair), pa.int64()), "a": pa.array(a[pair] if len(pair) else [], pa.int32()), "b": pa.array(b[pair] if len(pair) else [], pa.int32()), "times": times})

    return encoded.select("doc_id", "a", "b", "n_words", "word", "occurs", "n_pairs", "pair", "times").mapInArrow(each, "doc_id long, a int, b int, times long")


def op12(spark, sf_dir: str) -> DataFrame:
    encoded = encode(documents(spark, sf_dir))
    return scored(encoded, pair_counts(encoded))
