"""Toxicity: Levenshtein automata on a lexicon trie find misspelled terms; context windows tell quotation from abuse.

The lexicon is learned from labelled rows: whole words and word stems that toxic documents hold and others do not, chosen
greedily until they cover the toxic sample. Every other word of a document is walked through the trie with the states of
a Levenshtein automaton, from the root on, so all terms within the distance are found in one walk that ends at the first
dead state, wherever the error stands; stems take part as prefixes. What a hit with so many edits is worth is learned
from the labelled rows too, term by term. Each hit is weighed by how it was found and by its window: a hit inside quotation marks, or
near words that report or name speech, counts less than a bare one. A document's score is the chance that at least one
of its hits is abuse; what its other words say moves it by at most ``FAINT``, so that documents without a hit are ranked.

Labels, language, source and id are never inputs of a score.

Defined cases: null or empty text has score 0; without a toxic labelled row the lexicon is empty and all scores are 0;
without a certain term the faint evidence of words is all there is;
rows with a null doc_id or label are scored but not learned from; repeated labels count once for each text; extra
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import documents, stage

#: Labelled rows that the lexicon is learned from, at most, of each label; a fixed bound, drawn by a hash of the id. All
#: that reaches the driver (terms, near words, word evidence) is bounded by it.
SAMPLE = 6000
STEMS = range(4, 9)
CERTAIN = 8.0  # natural logarithm
# Words that report or name speech, marks that quote, and digits and signs that stand for letters.
REPORTING = frozenset("said says say saying called calls calling wrote writes quote quoted quotes word words term terms phrase insult slur sagte nannte schrieb wort zitat dit appelle mot terme dijo llamó escribió palabra término".split())
QUOTES = "\"'“”„«»‘’‚‹›`"
# The marks that close a quotation, by the mark that opens it.
CLOSING = {'"': '"', "'": "'’", "“": "”\"", "”": "”", "„": "“”\"", "«": "»", "»": "«", "‘": "’'", "’": "’", "‚": "‘’", "‹": "›", "›": "‹", "`": "`'"}
LEET = str.maketrans("013457@$", "oleastas")
EDGE = ".,;:!?*%&$#|<>()[]{}/\\-_~^+=…" + QUOTES
BARE, QUOTED, NEAR, FAINT = 0.8, 0.2, 0.5, 0.05
#: What a hit by one or two edits is worth before labelled rows say so, and how many rows that belief stands for.
PRIOR, BELIEF = {1: 0.35, 2: 0.175}, 10
WINDOW = 6
_letters = re.compile(r"[^\W\d_]+")


def distance_for(term: str, stem: bool = False) -> int:
    """Edits that a term allows: none for short ones, whose neighbours are other words, and one for long stems."""
    if stem:
        return int(len(term) >= 6)
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Trie:
    """Terms by their letters; a node is [children, term or None, stem or None, largest distance below, letters that all
    terms below have]."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.root, self.weight = [{}, None, None, 0, -1], {**stems, **words}
        self.bit = {c: 1 << i for i, c in enumerate(sorted({c for t in self.weight for c in t}))}
        for slot, terms in ((1, words), (2, stems)):
            for t in terms:
                node, far, letters = self.root, distance_for(t, slot == 2), sum(self.bit[c] for c in set(t))
                for c in t:
                    node[3] = max(node[3], far)
                    node[4] &= letters
                    node = node[0].setdefault(c, [{}, None, None, 0, -1])
                node[slot], node[3], node[4] = t, max(node[3], far), node[4] & letters
        self.all = sum(self.bit.values())

    def exact(self, word: str) -> str | None:
        """The term that the word is, or the longest stem that it starts with."""
        node, found = self.root, None
        for c in word:
            if node[2] is not None:
                found = node[2]
            if (node := node[0].get(c)) is None:
                return found
        return node[1] or node[2] or found

    def near(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its distance, and the edits; ties go to the first term.

        The automaton's state is, for each number of edits, the set of lengths of the word's prefixes that the trie's
        path is that many edits away from, as bits. An edit is an insertion, deletion, substitution or swap of
        neighbours. A path ends where no state is left within the largest distance of the terms below it, and isn't begun
        where the word lacks more of the letters that all of them have: an edit makes up for one such letter at most. A stem
        accepts at any prefix of the word, a term at the whole.
        """
        n, at, best = len(word), {}, None
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        get, lacks = at.get, self.all
        for c in at:
            lacks &= ~self.bit.get(c, 0)
        whole, most = 1 << n, (2 << n) - 1
        todo = [(self.root, "", 1, 3 & most, 7 & most, 0, 0)]
        while todo:
            node, c, s0, s1, s2, p0, p1 = todo.pop()
            swap = get(c, 0) >> 1
            for d, child in node[0].items():
                far = child[3]
                if (child[4] & lacks).bit_count() > far:
                    continue
                m, r1, r2 = get(d, 0), 0, 0
                r0 = (s0 & m) << 1
                if far:
                    r1 = ((s1 & m) << 1 | s0 << 1 | s0 | r0 << 1 | (p0 & m & swap) << 2) & most
                    if far == 2:
                        r2 = ((s2 & m) << 1 | s1 << 1 | s1 | r1 << 1 | (p1 & m & swap) << 2) & most
                new = (r0, r1, r2)
                if not new[far]:  # the states of fewer edits are among those of more
                    continue
                for t, stem in ((child[1], False), (child[2], True)):
                    if t is not None:
                        for k in range(distance_for(t, stem) + 1):
                            if new[k] if stem else new[k] & whole:
                                if best is None or (k, t) < best:
                                    best = (k, t)
                                break
                if child[0]:
                    todo.append((child, d, r0, r1, r2, s0, s1))
        return best and (best[1], best[0])


def quotations(text: str) -> set[int]:
    """Places of the words, white space apart, between a mark that opens and the first that closes it in the same line,
    however far; a mark that nothing closes is none."""
    quoted: set[int] = set()
    at = 0
    for line in text.split("\n"):
        opened: dict[str, int] = {}
        for w in line.split():
            if w[0] in QUOTES:
                opened.setdefault(w[0], at)
            last = w.rstrip(".,;:!?")[-1:]
            if last in QUOTES:
                # the word's own first mark may close, but doesn't if it is the whole word
                start = [i for c, i in opened.items() if last in CLOSING[c] and (i < at or len(w) > 1)]
                if start:
                    quoted.update(range(min(start), at + 1))
                    opened = {c: i for c, i in opened.items() if i < min(start)}
            at += 1
    return quoted


class Lexicon(NamedTuple):
    """What is learned: whole words and stems with their purity, near words that are none of them, the worth of a hit by
    its term and edits, and the faint evidence of other words."""

    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    benign: frozenset[str] = frozenset()
    fuzzy: dict[tuple[str, int], float] = {}
    faint: dict[str, float] = {}


class Scorer:
    """A lexicon with what has been found for words so far, kept within a bound."""

    def __init__(self, lexicon: Lexicon, cache: int = 400_000):
        self.trie, self.lexicon, self.size = Trie(lexicon.words, lexicon.stems), lexicon, cache
        self.clean: set[str] = set()
        self.hits: dict[str, float] = {}

    def weigh(self, raw: str) -> float:
        """How surely a word is a term: BARE as written, less by edits, 0 if it is none."""
        word, weight = raw.strip(EDGE), self.trie.weight
        for w in _letters.findall(word) if not word.isalpha() else [word]:
            if (t := self.trie.exact(w)) is not None:
                return BARE * weight[t]
        # digits and signs that stand for letters, then without any marks inside
        plain = word if word.isalpha() else "".join(_letters.findall(word.translate(LEET)))
        if not plain or plain in self.lexicon.benign:
            return 0.0
        if plain != word and (t := self.trie.exact(plain)) is not None:
            return BARE * weight[t]
        if len(plain) > 3 and (found := self.trie.near(plain)) is not None:
            return (self.lexicon.fuzzy.get(found, PRIOR[found[1]]) if found[1] else BARE) * weight[found[0]]
        return 0.0

    def faint(self, words: set[str]) -> float:
        """0 to 1: what the words say that are no terms."""
        got = [x for w in {w.strip(EDGE) for w in words} if (x := self.lexicon.faint.get(w)) is not None]
        return 1 / (1 + math.exp(-sum(got) / math.sqrt(len(got) or 1)))

    def look(self, words: set[str]) -> bool:
        """Learn the words not met before; True if any word is a hit."""
        if len(self.clean) + len(self.hits) > self.size:
            self.clean, self.hits = set(), {}
        any_hit = False
        for w in words - self.clean:
            if w not in self.hits:
                core = w.strip(EDGE)  # all that weigh() sees of a word
                if (x := 0.0 if core in self.clean else self.hits.get(core) or self.weigh(core)) > 0:
                    self.hits[w] = x
                else:
                    self.clean.add(w)
                    continue
            any_hit = True
        return any_hit

    def score(self, text: str | None) -> tuple[float, int, int]:
        """(score, hits, quoted hits) of a whole text."""
        low = (text or "").lower()
        words = low.split()
        if not words:
            return 0.0, 0, 0
        known = set(words)
        faint = FAINT * self.faint(known) if self.lexicon.faint else 0.0
        if not self.look(known):
            return faint, 0, 0
        quoted = quotations(low)
        safe, n, n_quoted = 1.0, 0, 0
        for i, w in enumerate(words):
            if (x := self.hits.get(w)) is None:
                continue
            n += 1
            if i in quoted:
                n_quoted += 1
                x *= QUOTED
            elif any(v.strip(EDGE) in REPORTING for v in words[max(0, i - WINDOW) : i + WINDOW + 1]):
                x *= NEAR
            safe *= 1 - x
        return 1 - safe * (1 - faint), n, n_quoted


def _terms(words: set[str]) -> set[str]:
    """Whole words as they are, stems with a trailing *."""
    out = set(words)
    for w in words:
        out.update(w[:k] + "*" for k in STEMS if k < len(w))
    return out


def _words(text: str) -> set[str]:
    return {w for w in _letters.findall(text.lower()) if 3 <= len(w) <= 40}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """The lexicon from labels(doc_id, toxic): a bounded sample of rows of each label, drawn by a hash.

    Terms are counted by tasks and summed by Spark; the pure ones reach the driver, and of each toxic sample document
    which of these it holds.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    drawn = marks.where("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(marks.where("toxic <> 1").orderBy(order, "doc_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id").where("text is not null")
    rows = stage(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")
    sizes = {r.toxic == 1: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1:
        return Lexicon()

    def count(batches):
        got: Counter = Counter()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got.update((t, y == 1) for t in _terms(_words(t)))
        for i in range(0, len(keys := list(got)), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part]), pa.array([got[k] * k[1] for k in part], pa.int64()), pa.array([got[k] * (not k[1]) for k in part], pa.int64())], ["term", "n1", "n0"])

    tally = rows.mapInArrow(count, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    tally = stage(tally.where("n1 > 1 or n0 > 9"), "terms")
    # a term counts if its share of toxic documents is no accident among as many terms as there are (binomial bound)
    base, n, least = n1 / (n1 + n0 + 1), F.col("n1") + F.col("n0"), max(2, n1 // 500)
    share = F.col("n1") / n
    surprise = F.col("n1") * F.log(share / base) + F.col("n0") * F.log(F.greatest(1 - share, F.lit(1e-9)) / (1 - base))
    pure = tally.where((F.col("n1") >= least) & (F.col("n1") / n1 >= 20 * F.col("n0") / max(n0, 1)) & (surprise > CERTAIN))
    counts = {r.term: (r.n1, r.n0) for r in pure.orderBy("term").collect()}

    def holds(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(_terms(_words(t)) & counts.keys()) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], ["held"])

    held = [set(r.held) for r in rows.where("toxic = 1").select("text").mapInArrow(holds, "held array<string>").collect()]
    chosen: dict[str, float] = {}
    left = Counter(t for h in held for t in h)
    covered = np.zeros(len(held), bool)
    where: dict[str, list[int]] = {}
    for i, h in enumerate(held):
        for t in h:
            where.setdefault(t, []).append(i)
    while left:
        # most documents not covered yet, then most documents; a word before its stems, a long stem before a short one
        t = max(left, key=lambda t: (left[t], len(where[t]), not t.endswith("*"), len(t), t))
        if left[t] < least:
            break
        n_1, n_0 = counts[t]
        chosen[t] = (n_1 / n1) / (n_1 / n1 + (n_0 + 0.5) / (n0 + 1))
        for i in where[t]:
            if not covered[i]:
                covered[i] = True
                for u in held[i]:
                    left[u] -= 1
        left = Counter({u: n for u, n in left.items() if n > 0})
    # terms as frequent as those chosen cover no new document, but they are terms all the same
    floor = min((counts[t][0] for t in chosen), default=0)
    frequent = np.median([counts[t][0] for t in chosen]) / 2 if chosen else math.inf
    for t, (n_1, n_0) in counts.items():
        if not t.endswith("*") and n_1 >= max(floor, frequent) and n_0 == 0 and not any(t.startswith(c[:-1]) for c in chosen if c.endswith("*")):
            chosen.setdefault(t, 1.0)
    words, stems = {t: x for t, x in chosen.items() if not t.endswith("*")}, {t[:-1]: x for t, x in chosen.items() if t.endswith("*")}
    benign, fuzzy = near_words(rows, Trie(words, stems), n1, n0)
    often = tally.where((n >= 10) & ~F.col("term").endswith("*")).select("term", F.log((F.col("n1") + 0.5) / (n1 + 1) * (n0 + 1) / (F.col("n0") + 0.5)).alias("x"))
    faint = {r.term: r.x for r in often.collect() if r.term not in words}
    return Lexicon(words, stems, benign, fuzzy, faint)


def near_words(rows: DataFrame, trie: Trie, n1: int, n0: int) -> tuple[frozenset[str], dict[tuple[str, int], float]]:
    """(words of other labelled rows that are near a term, worth of a hit by its term and edits).

    The worth is the share of toxic rows among rows with such a hit, were both labels as frequent. Rows that are not
    toxic are cut in two by a hash: a near word of one half is no hit in the other. Toxic rows that hold a term as written
    say nothing here, for the terms come from them.
    """

    def each(batches):
        for b in batches:
            out = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mark, words = zlib.crc32(t.encode()), _words(t)
                other = [w for w in words if trie.exact(w) is None]
                if y != 1 or len(other) == len(words):
                    out += [(f"{t[:16]} {mark}", y == 1, mark & 1, w, *found) for w in other if (found := trie.near(w))]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.int32()))], ["row", "toxic", "half", "word", "term", "edits"])

    hits = stage(rows.mapInArrow(each, "row string, toxic boolean, half int, word string, term string, edits int"), "near")
    others = hits.where("not toxic").groupBy("word").agg(F.collect_set("half").alias("halves"))
    both = hits.join(others, "word", "left").withColumn("fresh", F.when(F.col("toxic"), F.col("halves").isNull()).otherwise(F.size("halves") == 1))
    yes, no = F.count_distinct(F.when(F.col("toxic"), F.col("row"))), F.count_distinct(F.when(~F.col("toxic"), F.col("row")))
    seen = both.where("fresh").groupBy("term", "edits").agg(yes.alias("yes"), no.alias("no")).collect()
    fuzzy = {(r.term, r.edits): min(BARE, BARE * (r.yes + BELIEF * PRIOR[r.edits] / BARE) / (r.yes + r.no * n1 / max(n0, 1) + BELIEF)) for r in seen}
    return frozenset(r.word for r in others.select("word").collect()), fuzzy


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, n_hits, n_quoted) for each row's whole text."""
    kept: list[Scorer] = []

    def each(batches):
        if not kept:
            kept.append(Scorer(lexicon))
        for b in batches:
            got = [kept[0].score(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*got)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["doc_id", "score", "n_hits", "n_quoted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, score double, n_hits long, n_quoted long")


def with_score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All columns of docs and _score, the score of each row's whole text; a column of that name is replaced."""
    docs, kept = docs.drop("_score"), []
    at = docs.columns.index("text")

    def each(batches):
        if not kept:
            kept.append(Scorer(lexicon))
        for b in batches:
            score = pa.array([kept[0].score(t)[0] for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, score], [*b.schema.names, "_score"])

    return docs.mapInArrow(each, docs.withColumn("_score", F.lit(0.0)).schema)


def held_out(doc_id="doc_id", mod: int = 5, rest: int = 0):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity(docs, learn(docs, labels.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_quoted")
