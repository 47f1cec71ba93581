"""Language-model scores by a gated recurrent network in numpy with a class-factored softmax over words.

The corpus' word counts are a Spark aggregation over all training rows. The ``LOCAL`` most frequent words are known to
every task; counts of all others stay in a table that documents join. Of the frequent words ``CLUSTERED`` fall into
classes by what stands near them; every other word belongs to a class by its form. A class has ``SLOTS`` slots: one for
each of its most frequent words and a last one for the rest, in which corpus counts decide. So

    P(word | past) = P(class | state) * P(slot | class, state) * P(word | slot)

and both softmaxes see the state of the network. Tasks train copies of it on their rows by truncated backpropagation
(``STEPS`` words) and Adam; the copies' weights are averaged after each of ``ROUNDS`` rounds, summed by tasks in two
levels. A round takes the training rows of its share of a hash, so that every training row gives gradients once, and all
give counts. Scoring carries the state across windows through the whole document; many documents run side by side.

Defined cases: null or empty text is its end token alone; a null doc_id counts as training; rows of equal ids are scored
one by one; without a training row all scores are finite and the base score is 0; extra columns are ignored; an empty
table gives no row.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import runs
from .common import documents, stage
from .toxicity import held_out

END = b"\n"
LOCAL, CLUSTERED, CLASSES, SLOTS, FEATURES, NEAR = 131_072, 8192, 48, 32, 32, 3
HIDDEN, STEPS, LANES, ROUNDS = 32, 24, 192, 2
PUNCTUATION = frozenset(range(33, 127)) - set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
FIRST = PUNCTUATION | set(b"0123456789")
FORMS = 8
START = CLASSES * SLOTS + FORMS  # the input before a document's first word
BLOCKS = 64


def words_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def form(word: bytes) -> int:
    """0 to 7: ends in punctuation, holds other than ASCII, starts with a digit or punctuation."""
    return (word[-1] in PUNCTUATION) + 2 * (not word.isascii()) + 4 * (word[0] in FIRST)


#: form() for a word column.
FORM_SQL = r"cast(word rlike '[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]\\z' as int) + 2 * cast(octet_length(word) <> char_length(word) as int) + 4 * cast(word rlike '^[\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E]' as int)"


def word_counts(training: DataFrame, most: int = 400_000) -> DataFrame:
    """(word, n) over all training rows; tasks sum what they meet in bounded dicts."""

    def each(batches):
        got: Counter = Counter()

        def rows():
            it = iter(got.items())
            while part := list(islice(it, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in part]), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                got.update(words_of(t))
                if len(got) > most:
                    yield from rows()
                    got = Counter()
        yield from rows()

    return training.select("text").mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def numbers(words: list[bytes], index: dict[bytes, int]) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word, -1 less its form for a word that the index lacks, and the words that it lacks."""
    out = np.fromiter(map(index.get, words, repeat(-1)), np.int32, len(words))
    lack = np.flatnonzero(out < 0)
    rare = [words[i] for i in lack.tolist()]
    out[lack] = [-1 - form(w) for w in rare]
    return out, rare


class Vocabulary:
    """What tasks know of the corpus: bounded, whatever its size."""

    def __init__(self, frequent: list[tuple[bytes, int]], n: int, v: int, forms: dict[int, tuple[int, int]]):
        self.words, self.n, self.v = [w for w, _ in frequent], n, v
        self.counts = np.array([c for _, c in frequent], np.int64)
        self.forms = forms  # form -> (tokens, words) of all words
        self.symbol = self.inside = None

    def ids(self) -> dict[bytes, int]:
        return dict(zip(self.words, range(len(self.words))))

    def settle(self, classes: np.ndarray) -> None:
        """Slots from the classes of the first words: symbol of each id, log10 of P(word | slot), and class priors."""
        k = len(classes)
        form_of = np.array([form(w) for w in self.words[k:]], np.int64)
        self.symbol = np.r_[np.zeros(k, np.int64), CLASSES * SLOTS + form_of].astype(np.int32)
        self.inside = np.zeros(len(self.words))
        mass = np.zeros(CLASSES * SLOTS + FORMS)
        for c in range(CLASSES):
            own = np.flatnonzero(classes == c)  # in order of frequency
            slot = np.minimum(np.arange(len(own)), SLOTS - 1)
            self.symbol[own] = c * SLOTS + slot
            rest = own[SLOTS - 1 :]
            if len(rest):
                self.inside[rest] = np.log10(self.counts[rest] / self.counts[rest].sum())
            np.add.at(mass, c * SLOTS + slot, self.counts[own])
        tokens, kinds = (np.array([self.forms.get(f, (0, 0))[i] for f in range(FORMS)], np.int64) for i in (0, 1))
        for w, c in zip(self.words[:k], self.counts[:k].tolist()):
            tokens[form(w)] -= c
            kinds[form(w)] -= 1
        self.form_size = np.log10(tokens + kinds + 1)
        mass[CLASSES * SLOTS :] = tokens + 1
        # 10 ** inside * size of the form is the count plus one
        self.inside[k:] = np.log10(self.counts[k:] + 1) - self.form_size[form_of]
        self.mass = mass


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most `most` words by falling count: a histogram of counts sets the least count that fits."""
    bucket = F.floor(F.log2("n") * 64).cast("int")
    sizes = {r.b: r["count"] for r in counts.groupBy(bucket.alias("b")).count().collect()}
    least, total = 1 << 30, 0
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = b
    return sorted(((r.word.encode(), r.n) for r in counts.where(bucket >= least).collect()), key=lambda x: (-x[1], x[0]))


def summed(parts: DataFrame) -> DataFrame:
    """(block, part, vec) -> (block, vec): sums by block, added up in two levels as rows stream by."""

    def each(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                v = v.values.to_numpy().astype(np.float64)
                got[k] = got[k] + v if k in got else v
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array(list(got.values()), pa.list_(pa.float64()))], ["block", "vec"])

    one = parts.repartition("block", "part").select("block", "vec").mapInArrow(each, "block int, vec array<double>")
    return one.repartition("block").mapInArrow(each, "block int, vec array<double>")


def as_rows(flat: np.ndarray):
    """One batch of (block, part, vec) that holds a task's array, for summed()."""
    cut = np.array_split(flat.astype(np.float64), BLOCKS)
    part = TaskContext.get().partitionId() % 16
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([part] * BLOCKS, pa.int32()), pa.array(cut, pa.list_(pa.float64()))], ["block", "part", "vec"])


PARTS = "block int, part int, vec array<double>"


def gathered(parts: DataFrame) -> np.ndarray | None:
    """The summed array on the driver: as large as the model, not as the corpus."""
    got = {r.block: r.vec for r in summed(parts).collect()}
    return np.concatenate([got[k] for k in sorted(got)]) if got else None


def neighbour_counts(training: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """For each clustered word, how often each of the most frequent words stands within NEAR places of it."""
    k = min(CLUSTERED, len(vocab.words))

    def each(batches):
        ids, out = vocab.ids(), np.zeros((k, FEATURES))
        for b in batches:
            texts = b.column(0).to_pylist()
            for s, e in runs([len(t or "") + 1 for t in texts], 2_000_000):
                x = np.concatenate([numbers(words_of(t), ids)[0] for t in texts[s:e]]).astype(np.int64)
                for d in range(1, NEAR + 1):
                    for w, c in ((x[d:], x[:-d]), (x[:-d], x[d:])):
                        ok = (w >= 0) & (w < k) & (c >= 0) & (c < FEATURES)
                        out += np.bincount(w[ok] * FEATURES + c[ok], minlength=k * FEATURES).reshape(k, FEATURES)
        yield as_rows(out.ravel())

    got = gathered(training.select("text").mapInArrow(each, PARTS)) if k else None
    return np.zeros((k, FEATURES)) if got is None else got.reshape(k, FEATURES)


def cluster(near: np.ndarray, counts: np.ndarray, classes: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """Weighted k-means on square roots of neighbour shares; seeds are drawn far apart, by a fixed generator."""
    x = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))
    weight = np.sqrt(counts[: len(x)].astype(float))
    if len(x) <= classes:
        return np.arange(len(x))
    rng, centre, far = np.random.default_rng(1), x[:1], None
    for _ in range(classes - 1):
        d = ((x - centre[-1]) ** 2).sum(axis=1)
        far = d if far is None else np.minimum(far, d)
        p = far * weight + 1e-12
        centre = np.r_[centre, x[rng.choice(len(x), p=p / p.sum())][None]]
    for _ in range(rounds):
        label = (x @ centre.T * -2 + (centre**2).sum(axis=1)).argmin(axis=1)
        for c in range(classes):
            if (own := label == c).any():
                centre[c] = np.average(x[own], axis=0, weights=weight[own])
    return label


class Network:
    """The weights by name, on one flat float32 array."""

    SHAPES = {"inp": (START + 1, 3 * HIDDEN), "rec": (HIDDEN, 3 * HIDDEN), "cls": (HIDDEN, CLASSES + FORMS), "cls_b": (CLASSES + FORMS,), "slot": (CLASSES, HIDDEN, SLOTS), "slot_b": (CLASSES, SLOTS)}
    SIZE = sum(math.prod(s) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat, at = np.ascontiguousarray(flat, np.float32), 0
        for name, shape in self.SHAPES.items():
            setattr(self, name, self.flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)

    @classmethod
    def first(cls, mass: np.ndarray) -> Network:
        """Says what the counts say; its state is random."""
        rng, net = np.random.default_rng(2), cls(np.zeros(cls.SIZE))
        net.inp[:] = rng.normal(0, 0.2, net.inp.shape)
        net.rec[:] = rng.normal(0, HIDDEN**-0.5, net.rec.shape)
        slots = mass[: CLASSES * SLOTS].reshape(CLASSES, SLOTS)
        of_class = np.r_[slots.sum(axis=1), mass[CLASSES * SLOTS :]] + 1e-3
        net.cls_b[:] = np.log(of_class / of_class.sum())
        net.slot_b[:] = np.log((slots + 1e-6) / (slots.sum(axis=1, keepdims=True) + 1e-6 * SLOTS))
        return net

    def step(self, x: np.ndarray, h: np.ndarray):
        """The gated unit: (new state, what its backward step needs)."""
        a, r = self.inp[x], h @ self.rec
        gates = a[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN]
        np.negative(gates, gates)
        np.exp(np.minimum(gates, 60, out=gates), gates)
        np.reciprocal(gates + 1, gates)
        z, g = gates[:, :HIDDEN], gates[:, HIDDEN:]
        m = np.tanh(a[:, 2 * HIDDEN :] + g * r[:, 2 * HIDDEN :])
        return m + z * (h - m), (z, g, m, r[:, 2 * HIDDEN :])

    @staticmethod
    def tame(w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True if no state, whose parts are all within -1 and 1, makes exp of a logit overflow or all of them vanish."""
        return (np.abs(w).sum(axis=-2) + np.abs(b)).max(axis=-1) < 60

    def log_p(self, h: np.ndarray, target: np.ndarray, grad: Network | None = None):
        """Natural log of P(symbol) for each state; with grad, adds the gradient of their negative sum and returns it for h."""
        c = np.where(target < CLASSES * SLOTS, target // SLOTS, target - CLASSES * SLOTS + CLASSES)
        rows = np.arange(len(c))
        e = h @ self.cls
        e += self.cls_b
        if not self.tame(self.cls, self.cls_b):
            e -= e.max(axis=1, keepdims=True)
        own = e[rows, c]
        np.exp(e, e)
        total, dh = e @ np.ones(e.shape[1], np.float32), None
        if grad is not None:
            e *= np.reciprocal(total)[:, None]
            e[rows, c] -= 1
            grad.cls += h.T @ e
            grad.cls_b += e.sum(axis=0)
            dh = e @ self.cls.T
        order = np.argsort(c.astype(np.uint8), kind="stable")
        ends = np.searchsorted(c[order], np.arange(CLASSES + 1)).tolist()
        hs, slots, last = h[order], target[order] % SLOTS, ends[-1]
        inner, sums = np.zeros(len(c), np.float32), np.ones(len(c), np.float32)
        back, ones, tame = np.zeros((last if grad is not None else 0, HIDDEN), np.float32), np.ones(SLOTS, np.float32), self.tame(self.slot, self.slot_b)
        for k in range(CLASSES):
            a, b = ends[k], ends[k + 1]
            if a == b:
                continue
            e = hs[a:b] @ self.slot[k]
            e += self.slot_b[k]
            if not tame[k]:
                e -= e.max(axis=1, keepdims=True)
            at = rows[: b - a], slots[a:b]
            inner[a:b] = e[at]
            np.exp(e, e)
            sums[a:b] = e @ ones
            if grad is not None:
                e *= np.reciprocal(sums[a:b])[:, None]
                e[at] -= 1
                grad.slot[k] += hs[a:b].T @ e
                grad.slot_b[k] += e.sum(axis=0)
                back[a:b] = e @ self.slot[k].T
        inner[:last] -= np.log(sums[:last])
        out = own - np.log(total)
        out[order] += inner
        if grad is not None:
            dh[order[:last]] += back
        return out, dh


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, np.zeros(Network.SIZE, np.float32), np.zeros(Network.SIZE, np.float32)

    def update(self, net: Network, grad: Network) -> None:
        self.t += 1
        g = grad.flat
        norm = float(np.sqrt((g * g).sum()))
        if norm > 1:
            g *= 1 / norm
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        net.flat -= self.rate / (1 - 0.9**self.t) * self.m / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-6)


def train_window(net: Network, grad: Network, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray):
    """Truncated backpropagation over one window (steps, lanes): (state behind it, sum of natural logs)."""
    kept, states = [], []
    for t in range(len(x)):
        if fresh[t].any():
            h = np.where(fresh[t][:, None], np.float32(0), h)
        before = h
        h, cell = net.step(x[t], h)
        kept.append((before, *cell))
        states.append(h)
    grad.flat[:] = 0
    logs, dhs = net.log_p(np.concatenate(states), y.ravel(), grad)
    dhs = dhs.reshape(len(x), -1, HIDDEN) / y.size
    for part in (grad.cls, grad.cls_b, grad.slot, grad.slot_b):
        part /= y.size
    carry, das = np.zeros_like(h), []
    for t in reversed(range(len(x))):
        before, z, g, m, rm = kept[t]
        dh = dhs[t] + carry
        dm = dh * (1 - z) * (1 - m * m)
        dz = dh * (before - m) * z * (1 - z)
        dg = dm * rm * g * (1 - g)
        da = np.concatenate([dz, dg, dm], axis=1)
        dr = np.concatenate([dz, dg, dm * g], axis=1)
        grad.rec += before.T @ dr
        carry = dr @ net.rec.T + dh * z
        if fresh[t].any():
            carry = np.where(fresh[t][:, None], np.float32(0), carry)
        das.append(da)
    da, ids = np.concatenate(das[::-1]), x.ravel()
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    grad.inp[ids[order][at]] = np.add.reduceat(da[order], at, axis=0)
    return h, float(logs.sum())


def symbols(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Symbols of word numbers; numbers below 0 are forms."""
    return np.where(ids >= 0, vocab.symbol[np.maximum(ids, 0)] if len(vocab.symbol) else 0, CLASSES * SLOTS - 1 - ids).astype(np.int32)


def train(training: DataFrame, vocab: Vocabulary, net: Network, rate: float) -> tuple[Network, int, float]:
    """One round: (averaged network, tokens, mean natural log before and while its copies learned)."""
    start = net.flat

    def each(batches):
        ids, own, grad, adam = vocab.ids(), Network(start.copy()), Network(np.zeros(Network.SIZE)), Adam(rate)
        n, logs = 0, 0.0
        for b in batches:
            texts = b.column(0).to_pylist()
            for s, e in runs([len(t or "") + 1 for t in texts], 2_000_000):
                y, first = [], []
                for t in texts[s:e]:
                    y.append(numbers(words_of(t), ids)[0])
                    first.append(len(y[-1]))
                y = symbols(np.concatenate(y), vocab)
                fresh = np.zeros(len(y), bool)
                fresh[np.r_[0, np.cumsum(first)[:-1]]] = True
                x = np.where(fresh, START, np.r_[START, y[:-1]])
                lanes = max(1, min(LANES, len(y) // STEPS))
                length = -(-len(y) // lanes)
                at = np.arange(lanes * length) % len(y)  # the last lane is filled up from the start
                x, y, fresh = (a[at].reshape(lanes, length).T for a in (x, y, fresh))
                h = np.zeros((lanes, HIDDEN), np.float32)
                for t in range(0, length, STEPS):
                    h, got = train_window(own, grad, x[t : t + STEPS], np.ascontiguousarray(y[t : t + STEPS]), fresh[t : t + STEPS], h)
                    adam.update(own, grad)
                    logs += got
                n += lanes * length
        if n:
            yield as_rows(np.r_[own.flat.astype(np.float64) * n, n, logs])

    got = gathered(training.select("text").mapInArrow(each, PARTS))
    if got is None:
        return net, 0, 0.0
    return Network(got[:-2] / got[-2]), int(got[-2]), got[-1] / got[-2]


def score_documents(net: Network, y: np.ndarray, sizes: np.ndarray, lanes: int = 256, window: int = 64) -> np.ndarray:
    """log10 P of each document's symbols; documents follow each other in lanes, each from a state of zero."""
    starts = np.cumsum(sizes) - sizes
    load = [(0, k) for k in range(min(lanes, len(sizes)))]
    held: list[list[int]] = [[] for _ in load]
    for d in np.argsort(-sizes, kind="stable").tolist():
        n, k = heapq.heappop(load)
        held[k].append(d)
        heapq.heappush(load, (n + int(sizes[d]), k))
    held.sort(key=lambda ds: -int(sizes[ds].sum()))
    length = np.array([int(sizes[ds].sum()) for ds in held])
    at = [np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in ds]) for ds in held]
    fresh = np.zeros(len(y), bool)
    fresh[starts] = True
    x = np.where(fresh, START, np.r_[START, y[:-1]])
    owner, out = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(sizes))
    h = np.zeros((len(held), HIDDEN), np.float32)
    for w in range(0, int(length[0]), window):
        live = int(np.searchsorted(-length, -w, side="left"))  # lanes longer than w
        grid = np.full((window, live), -1, np.int64)
        for k in range(live):
            part = at[k][w : w + window]
            grid[: len(part), k] = part
        states, places = [], []
        for t in range(window):
            n = int(np.searchsorted(-length[:live], -(w + t), side="left"))
            if not n:
                break
            place = grid[t, :n]
            new = fresh[place]
            state = h[:n]
            if new.any():
                state = np.where(new[:, None], np.float32(0), state)
            h[:n] = net.step(x[place], state)[0]
            states.append(h[:n].copy())
            places.append(place)
        place = np.concatenate(places)
        logs, _ = net.log_p(np.concatenate(states), y[place])
        out += np.bincount(owner[place], logs.astype(np.float64), len(sizes))
    return out / math.log(10)


PARTIAL = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<string>"


def partial_scores(docs: DataFrame, vocab: Vocabulary, net: Network) -> DataFrame:
    """All of a row's score but what needs the counts of its rare words, which it lists."""
    unseen, start = math.log10(vocab.n + vocab.v + 1), net.flat

    def each(batches):
        ids, own = vocab.ids(), Network(start)
        base = np.log10(vocab.counts + 1)
        rid = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in runs([len(t or "") + 1 for t in texts], 8_000_000):  # many lanes for the longest document's time
                x, rare, ends = [], [], [0]
                for t in texts[s:e]:
                    got, lacked = numbers(words_of(t), ids)
                    x.append(got)
                    rare += lacked
                    ends.append(len(rare))
                sizes = np.array([len(got) for got in x])
                x = np.concatenate(x)
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare, pa.binary()).cast(pa.string()))
                owner, n = np.repeat(np.arange(e - s), sizes), e - s
                known, some = x >= 0, len(vocab.words) > 0
                at = np.maximum(x, 0)
                inside = np.where(known, vocab.inside[at] if some else 0, -vocab.form_size[np.maximum(-1 - x, 0)])
                score = score_documents(own, symbols(x, vocab), sizes) + np.bincount(owner, inside, n)
                plain = np.bincount(owner, np.where(known, base[at] if some else 0, 0.0), n) - sizes * unseen
                cols = [pa.array(np.arange(rid, rid + n)), b.column(0).slice(s, n), b.column(2).slice(s, n), pa.array(sizes, pa.int64()), pa.array(np.bincount(owner, known, n).astype(np.int64)), pa.array(plain), pa.array(score), rare]
                rid += n
                yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(each, PARTIAL)


def language_scores(docs: DataFrame, held_out_flag) -> DataFrame:
    """docs and a boolean column of held-out rows -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out_flag.alias("held_out"))
    training = docs.where("not held_out")
    counts = stage(word_counts(training), "counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    forms = {r.f: (r.n, r.v) for r in counts.groupBy(F.expr(FORM_SQL).alias("f")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    vocab = Vocabulary(frequent_words(counts, LOCAL), n, v, forms)
    vocab.settle(cluster(neighbour_counts(training, vocab), vocab.counts))
    net = Network.first(vocab.mass)
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        net, _, _ = train(training.where(turn == k), vocab, net, 0.01 / (1 + k))
    part = stage(partial_scores(docs, vocab, net), "scores")
    rare = part.select("rid", F.explode("rare").alias("word"))
    added = rare.join(counts, "word").groupBy("rid").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("n") + 1)).alias("gain"))
    both = part.drop("rare").join(added, "rid", "left")
    more = F.coalesce("gain", F.lit(0.0))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def op5(spark, sf_dir: str) -> DataFrame:
    return language_scores(documents(spark, sf_dir), held_out(mod=7, rest=2))
