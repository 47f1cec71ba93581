"""Each operator's query against a brute-force version on whole small tables, and each operator on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tallyspark.llm.common import components
from tallyspark.llm import attribution, bpe, crosswalk, infill, lines, mixing, mpeg, packing, quality, recurrent, simhash, substrings, toxicity

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 3000
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "Ünïcode – ‘quoted’ wörds, don't stop!"), (5, LONG), (5, LONG), (6, LONG), (None, "no id here"),
    (7, "a\n\nb\na\r\nb  "), (8, "x" * 5000), (9, " ".join(f"w{i}" for i in range(120))), (10, " ".join(f"w{i}" for i in range(20, 140))), (11, "<|endoftext|> 'S 12 ½ İ\x1c z"),
]


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"]))


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Awkward rows with an extra column whose name clashes with the operators' own."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else "s", len(t or ""), 0.5, k) for k, (i, t) in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, h1 int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, None, None), (9, 1, 1), (10, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "labels"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


ALL = {"op1": toxicity.op1, "op2": bpe.op2, "op3": packing.op3, "op4": substrings.op4, "op5": recurrent.op5, "op6": mpeg.op6, "op7": simhash.op7, "op8": lines.op8, "op9": quality.op9, "op10": attribution.op10, "op11": infill.op11, "op12": crosswalk.op12, "op13": mixing.op13}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, empty_dir, name):
    assert ALL[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", ["op4", "op8", "op9", "op11"])
def test_equals_sql(spark, name):
    from oracle import difference
    from tallyspark.llm.queries import oracle_sql, queries

    full = next(k for k in oracle_sql() if k.startswith(name + "_"))
    assert difference(spark, queries()[full], oracle_sql()[full], SF) is None


@pytest.mark.parametrize("name", [k for k in ALL if k not in ("op3", "op10")])
def test_one_row_for_each(spark, odd_dir, name):
    got = ALL[name](spark, odd_dir).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD)


def test_op1(spark, odd_dir):
    """Held-out accuracy: most toxic rows of the unseen fold are found, next to no clean one is."""
    big = "/root/testdata/sf0.1"
    got = toxicity.op1(spark, big).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    toxic = [r.predicted for r in got if r.held_out and truth.get(r.doc_id) == 1]
    clean = [r.predicted for r in got if r.held_out and truth.get(r.doc_id) == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02
    texts = spark.read.parquet(f"{big}/documents.parquet").select("text").distinct().count()
    assert len({r.score for r in got}) > 0.98 * texts  # nearly all different texts are ranked
    odd = {r.doc_id: r.score for r in toxicity.op1(spark, odd_dir).collect()}
    assert odd[1] == odd[2] == odd[3] == 0


def test_levenshtein_and_quotation():
    s = toxicity.Scorer(toxicity.Lexicon({"worthless": 1.0}))
    assert s.score("you are worthless")[0] > s.score("you are worhtless")[0] > 0 == s.score("you are fine")[0]
    assert s.score('they wrote "worthless" there')[0] < s.score("you are worthless")[0]
    assert s.score("w0rthless")[0] == s.score("worthless")[0] == s.score("worth-less")[0]
    assert all(s.score(f"you are {w}")[0] > 0 for w in ("vorthless", "orthless", "owrthless", "xworthless", "w*rthless"))


def test_quotations_of_any_length():
    s = toxicity.Scorer(toxicity.Lexicon({"worthless": 1.0}))
    far = " ".join(f"w{k}" for k in range(60))
    bare = s.score("you are worthless")[0]
    for text in (f'"{far} worthless {far}"', f"“{far} worthless {far}”", f"«worthless {far}», so", f"„{far} worthless“", f"'tis so: \"{far} worthless\" {far}"):
        assert s.score(text)[1:] == (1, 1) and s.score(text)[0] < bare
    # no mark closes, one of another kind closes, or the line ends before
    for text in (f'" {far} worthless {far}', f"“{far} worthless {far}»", f'"{far}\nworthless {far}"', f"' {far} worthless"):
        assert s.score(text)[1:] == (1, 0)
    # a word that reports counts as far ahead as back
    pad = lambda k: " ".join("zz" for _ in range(k))
    assert s.score(f"said {pad(5)} worthless")[0] == s.score(f"worthless {pad(5)} said")[0] == toxicity.BARE * toxicity.NEAR
    assert s.score(f"said {pad(6)} worthless")[0] == s.score(f"worthless {pad(6)} said")[0] == toxicity.BARE


def plain_score(text, lex):
    """The score by its definition: every word against every term, every window looked through."""
    words = (text or "").lower().split()
    weight = {**lex.stems, **lex.words}

    def worth(raw):
        word = raw.strip(toxicity.EDGE)
        exact = lambda w: w if w in lex.words else max((t for t in lex.stems if w.startswith(t)), key=len, default=None)
        for w in re.findall(r"[^\W\d_]+", word) if not word.isalpha() else [word]:
            if (t := exact(w)) is not None:
                return toxicity.BARE * weight[t]
        plain = word if word.isalpha() else "".join(re.findall(r"[^\W\d_]+", word.translate(toxicity.LEET)))
        if not plain or plain in lex.benign:
            return 0.0
        if plain != word and (t := exact(plain)) is not None:
            return toxicity.BARE * weight[t]
        near = [(k, t) for t in lex.words if (k := edits(t, plain)) <= toxicity.distance_for(t)]
        near += [(k, t) for t in lex.stems if (k := min(edits(t, plain[:i]) for i in range(len(plain) + 1))) <= toxicity.distance_for(t, True)]
        if len(plain) > 3 and near:
            k, t = min(near)
            return (lex.fuzzy.get((t, k), toxicity.PRIOR[k]) if k else toxicity.BARE) * weight[t]
        return 0.0

    if not words:
        return 0.0
    known = [lex.faint[w] for w in sorted({w.strip(toxicity.EDGE) for w in words}) if w in lex.faint]
    faint = toxicity.FAINT / (1 + math.exp(-sum(known) / math.sqrt(len(known) or 1))) if lex.faint else 0.0
    quoted, safe = toxicity.quotations((text or "").lower()), 1.0
    for i, w in enumerate(words):
        x = worth(w)
        near = words[max(0, i - toxicity.WINDOW) : i] + words[i : i + toxicity.WINDOW + 1]
        safe *= 1 - x * (toxicity.QUOTED if i in quoted else toxicity.NEAR if any(v.strip(toxicity.EDGE) in toxicity.REPORTING for v in near) else 1)
    return 1 - safe * (1 - faint)


def test_scores_equal_their_definition(spark):
    docs_, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    lex = toxicity.learn(docs_, labels)
    assert lex.words or lex.stems
    s = toxicity.Scorer(lex)
    terms = [*lex.words, *lex.stems]
    rng = np.random.default_rng(8)
    bent = [t[:k] + "x" + t[k + 1 :] for t in terms for k in (0, len(t) // 2)] + [t[1:] for t in terms] + [t.upper() + "!" for t in terms] + ["said", '"', "'so", "end'", "and", "zzzz\n"]
    texts = [" ".join(rng.choice([*bent, *terms], 12)) for _ in range(60)] + [r.text[:600] for r in docs_.limit(60).collect()]
    for t in texts:
        assert s.score(t)[0] == pytest.approx(plain_score(t, lex), abs=1e-9)


def edits(a, b):
    """Optimal string alignment distance by the whole table."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_finds_all_terms_within_the_distance():
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcd"), n))
    words, stems = {word(int(rng.integers(3, 12))): 1.0 for _ in range(60)}, {word(int(rng.integers(4, 9))): 1.0 for _ in range(10)}
    trie, found = toxicity.Trie(words, stems), 0
    for _ in range(1500):
        w = word(int(rng.integers(3, 13)))
        want = [(k, t) for t in words if (k := edits(t, w)) <= toxicity.distance_for(t)]
        want += [(k, t) for t in stems if (k := min(edits(t, w[:i]) for i in range(len(w) + 1))) <= toxicity.distance_for(t, True)]
        got = trie.near(w)
        assert (got and (got[1], got[0])) == min(want, default=None)
        found += bool(want)
    assert found > 100


def encoder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})


def test_op2(spark, docs, odd_dir):
    enc = encoder()
    for d, rows in ((SF, docs), (odd_dir, ODD)):
        want = Counter((i, len(x := enc.encode_ordinary(t or "")), sha(" ".join(map(str, x))), sha(t or "")) for i, t in rows)
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2(spark, d).collect()) == want


def test_op2_unbroken_pieces():
    """Long pieces contract to the same ids, whatever repeats in them."""
    rng, enc, codec = np.random.default_rng(7), encoder(), bpe.Codec()
    draw = lambda parts, n: "".join(rng.choice(parts, n))
    texts = [draw(list("abcdefghijklmnopqrstuvwxyz"), n) for n in (65, 200, 1000)] + [draw(["action", "ing", "the", "tion", "a", "c", "t"], n) for n in (40, 300)]
    texts += [draw(list("acgt"), 2000), draw(list("абвгдежз"), 3000), "x" * 10_000, "ab" * 50_000, "=" * 1_000_000, "action" * 2000]
    for t in texts:
        assert np.frombuffer(codec.encode([t])[0], "<i4").tolist() == enc.encode_ordinary(t)


def test_op2_parts_agree(spark, docs):
    table = spark.createDataFrame(docs[:20], "doc_id long, text string")
    got = bpe.decode(bpe.encode(table)).collect()
    assert all(bytes(r.decoded).decode() == dict(docs)[r.doc_id] for r in got)


def test_op3(spark, docs, odd_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    for d, rows in ((SF, docs), (odd_dir, ODD)):
        got = packing.op3(spark, d).collect()
        pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
        want = Counter()
        for i, text in rows:
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            at = packing.cuts(len(ids))
            want.update((i, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids)) for a, b in zip(at, at[1:]))
        assert pieces == want
        windows = defaultdict(list)
        for r in got:
            windows[r.sequence_id].append((r.offset, r.length))
        for w in windows.values():
            w.sort()
            assert [o for o, _ in w] == [sum(n for _, n in w[:k]) for k in range(len(w))] and sum(n for _, n in w) <= 2048
        total = sum(r.length for r in got)
        assert len(windows) <= total / 2048 * 1.02 + 2


def test_op4(spark, docs, odd_dir):
    for d, rows in ((SF, docs), (odd_dir, ODD)):
        texts = [(i, WORD.findall(t or "")) for i, t in rows]
        first = {}
        for i, w in texts:
            for k in range(len(w) - 49 if i is not None else 0):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
        want = Counter()
        for i, w in texts:
            gone = set()
            for k in range(len(w) - 49 if i is not None else 0):
                if first[tuple(w[k : k + 50])] < i:
                    gone.update(range(k, k + 50))
            want[i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op4(spark, d).collect()) == want


def test_op5(spark, docs, odd_dir):
    for d, rows in ((SF, docs), (odd_dir, ODD)):
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        count = Counter()
        for i, t in rows:
            if not held(i):
                count.update(recurrent.words_of(t))
        n, v = sum(count.values()), len(count)
        got = recurrent.op5(spark, d).collect()
        want = Counter()
        for i, t in rows:
            w = recurrent.words_of(t)
            want[i, held(i), len(w), sum(x in count for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 3)] += 1
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
        if d == SF:
            out = [r for r in got if r.held_out]
            assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_op5_trains_on_every_row(spark, monkeypatch):
    """Above 2 million tokens too, neighbour counts see all training rows, and gradients each of them once."""
    docs = spark.range(40).selectExpr("id as doc_id", "repeat('a b c d ', 20000) as text")
    trained, near, count = [], [], recurrent.neighbour_counts
    monkeypatch.setattr(recurrent, "train", lambda rows, vocab, net, rate: (trained.append(rows.select("doc_id").collect()) or net, 0, 0.0))
    monkeypatch.setattr(recurrent, "neighbour_counts", lambda rows, vocab: near.append(rows.count()) or count(rows, vocab))
    assert recurrent.language_scores(docs, recurrent.F.col("doc_id") % 8 == 0).where("train_tokens > 2000000").count() == 40
    assert near == [35] and sorted(r.doc_id for rows in trained for r in rows) == [i for i in range(40) if i % 8]


def plain_log10(net, vocab, counts, texts):
    """log10 P of each text word by word, by the definition of the model."""
    index = vocab.ids()
    out = []
    for t in texts:
        h, x, total = np.zeros(recurrent.HIDDEN), recurrent.START, 0.0
        for w in recurrent.words_of(t):
            n = recurrent.HIDDEN
            a, r = net.inp[x].astype(float), h @ net.rec.astype(float)
            z, g = (1 / (1 + np.exp(-(a[k : k + n] + r[k : k + n]))) for k in (0, n))
            m = np.tanh(a[2 * n :] + g * r[2 * n :])
            h = m + z * (h - m)
            i = index.get(w)
            y = int(vocab.symbol[i]) if i is not None else recurrent.CLASSES * recurrent.SLOTS + recurrent.form(w)
            c = y // recurrent.SLOTS if y < recurrent.CLASSES * recurrent.SLOTS else y - recurrent.CLASSES * recurrent.SLOTS + recurrent.CLASSES
            soft = lambda e: np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            p = soft(h @ net.cls + net.cls_b)[c]
            if c < recurrent.CLASSES:
                p *= soft(h @ net.slot[c] + net.slot_b[c])[y % recurrent.SLOTS]
            if i is not None and y < recurrent.CLASSES * recurrent.SLOTS:
                same = [vocab.counts[j] for j in range(len(vocab.words)) if vocab.symbol[j] == y]
                p *= vocab.counts[i] / sum(same)
            else:
                p *= (counts.get(w, 0) + 1) / 10 ** vocab.form_size[recurrent.form(w)]
            total += math.log10(p)
            x = y
        out.append(total)
    return out


def test_op5_score_by_definition(spark, monkeypatch):
    """Scores of a small model, rare and unseen words included, equal a plain word-by-word version."""
    rng = np.random.default_rng(4)
    for name, value in (("LOCAL", 60), ("CLUSTERED", 40)):
        monkeypatch.setattr(recurrent, name, value)
    rows = [(i, " ".join(f"w{int(k)}{'.' * int(k % 3 == 0)}" for k in rng.zipf(1.3, int(rng.integers(1, 200))) % 120)) for i in range(30)] + [(30, ""), (31, None), (32, "ünseen 7up never.")]
    kept, first = [], recurrent.partial_scores
    monkeypatch.setattr(recurrent, "partial_scores", lambda docs, vocab, net: kept.append((vocab, net)) or first(docs, vocab, net))
    got = {r.doc_id: r.score for r in recurrent.language_scores(spark.createDataFrame(rows, "doc_id long, text string"), recurrent.F.col("doc_id") > 29).collect()}
    vocab, net = kept[0]
    counts = Counter(w for i, t in rows if i <= 29 for w in recurrent.words_of(t))
    for (i, _), want in zip(rows, plain_log10(net, vocab, counts, [t for _, t in rows])):
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want)), i


def test_op5_gradient():
    rng = np.random.default_rng(0)
    net = recurrent.Network.first(rng.random(recurrent.CLASSES * recurrent.SLOTS + recurrent.FORMS) + 0.1)
    net.flat[:] += rng.normal(0, 0.05, net.flat.shape)
    x, y = rng.integers(0, recurrent.START, (2, 3, 4))
    fresh, h = np.zeros((3, 4), bool), np.zeros((4, recurrent.HIDDEN), np.float32)
    grad = recurrent.Network(np.zeros(recurrent.Network.SIZE))
    recurrent.train_window(net, grad, x, y, fresh, h)
    for part in ("inp", "rec", "cls", "slot", "slot_b"):
        g = getattr(grad, part)
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        was = getattr(net, part)[at]
        loss = []
        for e in (0.01, -0.01):
            getattr(net, part)[at] = was + e
            loss.append(-recurrent.train_window(net, recurrent.Network(np.zeros(recurrent.Network.SIZE)), x, y, fresh, h)[1] / y.size)
        getattr(net, part)[at] = was
        assert abs((loss[0] - loss[1]) / 0.02 - g[at]) < 0.02 * abs(g[at]) + 2e-4


def test_op6(spark, docs, odd_dir):
    for d, rows in ((SF, docs), (odd_dir, ODD)):
        want = Counter((i, len(b := (t or "").encode()), len(p := mpeg.padded(b)), sha(p), zlib.crc32(p[-64:])) for i, t in rows)
        got = mpeg.op6(spark, d).collect()
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
        assert all(";n_bad_frames=0;n_unchecked_frames=0;skipped_bytes=0;" in ";" + r.feature for r in got)


def test_op6_resync_and_checksum():
    stored = mpeg.mux(bytes(range(256)) * 40)
    whole = mpeg.probe(stored)
    broken = bytearray(stored)
    broken[int(whole.offsets[2]) + 10] ^= 1
    assert mpeg.probe(bytes(broken)).good.tolist().count(False) == 1
    noisy = mpeg.probe(b"\x00\xff\xfbjunk" + stored[stored.index(b"\xff\xfa") :])
    assert len(noisy.offsets) == len(whole.offsets) and noisy.skipped > 0 and whole.tags["TSSE"] == "tallyspark"
    assert mpeg.probe(None).samples == 0 == mpeg.probe(b"nothing").samples


def stream_of(v: int, mono: bool, n: int = 6, rate: int = 5) -> bytearray:
    """Protected frames of version bits v, with right checksums bit by bit."""
    out = bytearray()
    side = (17 if mono else 32) if v == 3 else (9 if mono else 17)
    for i in range(n):
        head = bytes([0xFF, 0xE0 | v << 3 | 1 << 1, rate << 4 | 1 << 2, 0xC0 if mono else 0])
        code = int(mpeg.header_code(*(np.array([x]) for x in head[1:]))[0])
        size = int(mpeg.FRAMES[code, 0])
        body = bytearray(bytes((i * 7 + k) % 251 for k in range(size - 6)))
        c = 0xFFFF
        for byte in head[2:] + body[:side]:
            for bit in range(7, -1, -1):
                c = (c << 1 ^ (0x8005 if (c >> 15) ^ (byte >> bit & 1) else 0)) & 0xFFFF
        out += head + c.to_bytes(2, "big") + body
    return out


@pytest.mark.parametrize("v", [3, 2, 0])
@pytest.mark.parametrize("mono", [False, True])
def test_op6_checksums_of_all_modes(v, mono):
    raw = stream_of(v, mono)
    p = mpeg.probe(bytes(raw))
    assert len(p.offsets) == 6 and p.good.all() and p.checked.all()
    raw[int(p.offsets[3]) + 8] ^= 4
    assert mpeg.probe(bytes(raw)).good.tolist() == [True] * 3 + [False] + [True] * 2


def test_op6_tables():
    """Xing behind the side information of any mode, and VBRI at its fixed place; other frames keep exact offsets."""
    for v, mono in ((3, True), (2, False), (2, True)):
        raw = stream_of(v, mono, rate=9)
        side = int(mpeg.side_sizes(np.array([v << 9 | 3 * mono]))[0])
        raw[6 + side : 6 + side + 16] = b"Xing" + (3).to_bytes(4, "big") + (5).to_bytes(4, "big") + (999).to_bytes(4, "big")
        p = mpeg.probe(bytes(raw))
        assert (p.info["kind"], p.info["frames"], p.info["bytes"], len(p.offsets)) == ("Xing", 5, 999, 5)
    raw = stream_of(3, False, rate=9)
    raw[36:36 + 30] = b"VBRI" + bytes(6) + (1234).to_bytes(4, "big") + (5).to_bytes(4, "big") + b"\0\2\0\3\0\1\0\2" + bytes([10, 20]) + bytes(2)
    p = mpeg.probe(bytes(raw))
    assert (p.info["kind"], p.info["bytes"], p.info["frames"], p.info["steps"]) == ("VBRI", 1234, 5, [30, 60])
    assert p.offsets.tolist() == [k * len(raw) // 6 for k in range(1, 6)] and not mpeg.probe(bytes(raw)).skipped


def test_op6_all_frame_offsets(spark):
    docs = spark.createDataFrame([(1, "word " * 4000), (2, "")], "doc_id long, text string")
    got = mpeg.probe_media(mpeg.encode_media(docs)).select("*", mpeg.seek_points("offset_deltas", 4).alias("seek")).orderBy("doc_id").collect()
    for r in got:
        want = mpeg.probe(bytes(r.media)).offsets.tolist()
        assert np.cumsum(r.offset_deltas).tolist() == want and r.seek == [want[k * len(want) // 4] for k in range(4)] and r.n_unchecked_frames == 0


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_op7(spark, docs, odd_dir):
    for d, rows in ((SF, docs), (odd_dir, ODD)):
        fps = [(i, plain_fingerprint(t)) for i, t in rows]
        known = [(i, f) for i, f in fps if i is not None]
        comp = groups({i for i, _ in known}, [(a, b) for k, (a, f) in enumerate(known) for b, g in known[:k] if (f ^ g).bit_count() <= 4])
        want = Counter((i, f"{f:016x}", comp.get(i)) for i, f in fps)
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op7(spark, d).collect()) == want


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    rows = [(f ^ (1 << int(b)), 0) for f in fps[:5] for b in range(0, 50, 2)] + [(f, 0) for f in fps]
    rows = [(f, k) for k, (f, _) in enumerate(dict.fromkeys(rows))]
    nodes = spark.createDataFrame(rows, "fp long, rep long")
    ids = [k for _, k in rows]
    want = groups(ids, [(a, b) for x, a in rows for y, b in rows if a < b and ((x ^ y) & (2**64 - 1)).bit_count() <= 4])
    for blocks in (6, 7, 8):
        assert groups(ids, [(r.a, r.b) for r in simhash.links(nodes, blocks=blocks, tile=4).collect()]) == want
    assert [simhash.blocks_for(n, 4) for n in (10, 1 << 25, 1 << 31)] == [6, 7, 8]


def test_components_of_a_long_chain(spark):
    """Chains end in one component however long they are."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def line_docs(rows):
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    return held


def test_op8(spark, docs, odd_dir):
    for d, rows in ((SF, docs), (odd_dir, ODD)):
        held = line_docs(rows)
        want = Counter()
        for i, t in rows:
            all_lines = (t or "").split("\n")
            kept = [x for x in all_lines if not (key(x) and len(held[key(x)]) >= 10)]
            want[i, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept))] += 1
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.op8(spark, d).collect()) == want


@pytest.mark.parametrize("first", [False, True])
def test_lines_over_many_ranges(spark, first):
    """A hot line crosses the edges of many ranges; first occurrences stay exactly once."""
    rows = [(i, "\n".join(["Hot"] * (1 + i % 3) + [f"pair {i // 2}", f"own {i}", " hot "])) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.text.split("\n") for r in lines.apply_bitmaps(table, lines.line_bitmaps(table, 10, 1, first)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, _ in rows:
        want = [f"pair {i // 2}", f"own {i}"]
        assert got[i] == (["Hot", *want] if first and i == 0 else want)


def test_op9(spark, docs, odd_dir):
    for d, rows in ((SF, docs), (odd_dir, ODD)):
        want = Counter()
        for i, t in rows:
            t = t or ""
            w = WORD.findall(t)
            at = defaultdict(list)
            for k in range(len(w) - 7):
                at[tuple(w[k : k + 8])].append(k)
            rep = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(8)}
            some = [x for x in t.split("\n") if WORD.search(x)]
            failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
            want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(some) - len(set(some)), len(rep), failed] += 1
        got = quality.op9(spark, d).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
        assert sorted(map(str, got)) == sorted(map(str, quality.op9(spark, d).collect()))  # the same in every run


def test_op9_verdicts_by_sorted_ratios(spark):
    """Each verdict by the empty stretches of the sorted ratios of group, language and all, and by label."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r.asDict() for r in quality.judge(docs).collect()]

    def fence(some, k):
        x = sorted(r[k] for r in some)
        median, q3 = x[-(-2 * len(x) // 4) - 1], x[-(-3 * len(x) // 4) - 1]
        u = sorted(set(x))
        wide = [(b - a, -a) for a, b in zip(u, u[1:]) if a >= q3 and b - a >= quality.GAP and b - a > a - median]
        return max(wide)[0] // 3 - max(wide)[1] if wide else quality.BINS

    groups, langs, passed = defaultdict(list), defaultdict(list), [r for r in rows if not r["base_failed"]]
    for r in passed:
        groups[r["lang"], r["source"]].append(r)
        langs[r["lang"]].append(r)
    shrunk = lambda some, k, wide: (len(some) * fence(some, k) + quality.BELIEF * wide) // (len(some) + quality.BELIEF)
    limit = {(lang, source, k): shrunk(some, k, shrunk(langs[lang], k, fence(passed, k))) for (lang, source), some in groups.items() for k in quality.RATIOS}
    for r in rows:
        for k, (n, of) in quality.RATIOS.items():
            assert r[k] == 4096 * r[n] // max(1, sum(r[x] if x in r else int(x) for x in of.split(" + ")))
        assert r["kept"] == (not r["base_failed"] and all(r[k] <= limit[r["lang"], r["source"], k] for k in quality.RATIOS))
    assert len({v for (*_, k), v in limit.items() if k == "symbol_ratio"}) > 5  # groups have fences of their own
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    of = lambda y: [r["kept"] for r in passed if labels.get(r["doc_id"]) == y]
    assert np.mean(of(1)) > 0.99 and np.mean(of(0)) < 0.25


def test_op10(spark, docs, odd_dir):
    enc = encoder()
    for d, rows in ((SF, docs), (odd_dir, ODD)):
        got = attribution.op10(spark, d).collect()
        total = Counter()
        for r in got:
            total[r.doc_id] += r.n_tokens
            assert r.n_crossing <= r.n_tokens and r.start <= r.stop
        want = Counter()
        for i, t in rows:
            want[i] += len(enc.encode_ordinary(t or ""))
        assert {i: n for i, n in total.items()} == dict(want)


def plain_sections(enc, text, starts, rule):
    """Tokens and crossing tokens of each section, character by character."""
    stops, raw = [*starts[1:], len(text)], text.encode()
    owner = [len(text[: k + 1].encode()) for k in range(len(text))]  # the byte behind each character
    n, crossing, at = [0] * len(starts), [0] * len(starts), 0
    section = lambda k: max(i for i, s in enumerate(starts) if s <= k)
    for token in enc.encode_ordinary(text):
        end = at + len(enc.decode_single_token_bytes(token))
        chars = [k for k, e in enumerate(owner) if at <= e - len(text[k].encode()) < end]
        held = Counter(map(section, chars)) if chars else Counter({section(sum(e - len(text[k].encode()) < at for k, e in enumerate(owner))): 1})
        best = max(held, key=lambda s: (held[s], -s)) if rule == "most" else min(held)
        n[best] += 1
        crossing[best] += len(held) > 1
        at = end
    assert at == len(raw) and stops[-1] == len(text)
    return n, crossing


@pytest.mark.parametrize("rule", ["most", "first"])
def test_op10_sections_by_brute_force(spark, docs, rule):
    enc = encoder()
    rows = [(i, t[:600]) for i, t in docs[:25]] + [(1001, "# A\n- b\n\n1. c|d\n  \nx"), (1002, "ünï\n🙂🙃\n\n\nz"), (1003, "")]
    got = defaultdict(list)
    for r in attribution.section_tokens(spark.createDataFrame(rows, "doc_id long, text string"), rule).orderBy("doc_id", "section").collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        starts = [0, *(m.end() for m in re.finditer("\n", t) if m.end() < len(t))]
        assert [r.start for r in got[i]] == starts
        assert ([r.n_tokens for r in got[i]], [r.n_crossing for r in got[i]]) == plain_sections(enc, t, starts, rule)


def test_op10_spans_and_fields(spark):
    enc, t = encoder(), "Hello wonderful world, again"
    rows = [(1, t, [("a", 0, 8), ("b", 8, 15), ("c", 20, 99)]), (2, t, None), (3, None, [("a", 0, 3)])]
    table = spark.createDataFrame(rows, "doc_id long, text string, mine array<struct<kind:string,start:long,stop:long>>")
    got = attribution.section_tokens(table, spans="mine").orderBy("doc_id", "section").collect()
    assert [(r.kind, r.start) for r in got if r.doc_id == 1] == [("a", 0), ("b", 8), ("outside", 15), ("c", 20)]
    assert [r.n_tokens for r in got if r.doc_id == 1] == plain_sections(enc, t, [0, 8, 15, 20], "most")[0]
    assert [(r.kind, r.n_tokens) for r in got if r.doc_id > 1] == [("outside", len(enc.encode_ordinary(t))), ("outside", 0)]
    one = attribution.with_fields(spark.createDataFrame([(1, "Title here", None, "and a body")], "doc_id long, title string, sub string, body string"), ["title", "sub", "body"])
    by = {r.kind: r for r in attribution.section_tokens(one, spans="spans").collect() if r.kind != "outside"}
    assert (by["title"].start, by["title"].stop, by["body"].start) == (0, 10, 12)


def test_boundary_rule():
    first, stop, starts = np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 4, 6])
    assert attribution.attribute(first, stop, starts, "most")[0].tolist() == [2, 0, 1]
    assert attribution.attribute(first, stop, starts, "first")[0].tolist() == [2, 1, 0]


def infilled(doc_id, text, rate=100, spm=50):
    """(n, form, prefix, middle, suffix, output) by lists of units."""
    text = text or ""
    h = [int(sha(f"7:{'' if doc_id is None else doc_id}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, None, text
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


FILL = [
    *ODD, *((100 + k, "\x01\x02ab\n\x02a\x01\n\x02b\n" * k + "tail\x01" * (k % 2)) for k in range(40)),
    (200, "has <M> inside\nx"), (201, "<<P\n>S>\n<\n"), (202, "\n\n\n"), (203, "a\r\nb\u2028c\x85d\n"), (204, "$0 \\1 $x\n\\n\n"), (205, "x\n" * 50_000),
]


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (100, 100), (0, 50)])
def test_infill_equals_lists_of_units(spark, rate, spm):
    d = infill.transform(spark.createDataFrame(FILL, "doc_id long, text string"), rate=rate, spm=spm)
    got = d.withColumn("restored", infill.restore()).collect()
    key = lambda x: (str(x[0]), x[1])
    mine = sorted(((r.doc_id, r.text, (r.n, r.form, r.prefix, r.middle, r.suffix, r.output), r.restored) for r in got), key=key)
    assert mine == sorted(((i, t or "", infilled(i, t, rate, spm), t or "") for i, t in FILL), key=key)


def test_op11(spark, docs):
    got = {r.doc_id: r for r in infill.op11(spark, SF).collect()}
    for i, t in docs:
        n, form, p, m, _, out = infilled(i, t)
        assert tuple(got[i]) == (i, n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(t or ""))
    assert {r.form for r in got.values()} >= {"psm", "spm"}


def spark_hash(*values):
    """xxhash64() of ints (short ones as numpy's), longs and strings."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v) if isinstance(v, np.int32) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def mixed(rows, block=256, shard=1024, seed=13, most=3):
    """(doc_id, size, source_size, target, taken) of rows (doc_id, text, source), by whole lists of words, blocks and slots."""
    seed32 = np.int32(seed)
    rows = [(i, t, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    names = sorted({s for *_, s, _ in rows}, key=lambda s: (s is None, s or ""))
    z = [sum(r[3] for r in rows if r[2] == n) for n in names]
    weight, target, full = [(1, 2, 3)[k % 3] for k in range(len(names))], [0.0] * len(names), set()
    while True:  # share, stop at the limit, share the excess again
        rest = sum(z) - sum(most * z[k] for k in full)
        total = sum(weight[k] for k in range(len(names)) if k not in full) or 1
        target = [float(most * z[k]) if k in full else weight[k] * rest / total for k in range(len(names))]
        over = {k for k in range(len(names)) if k not in full and target[k] > most * z[k]}
        if not over:
            break
        full |= over

    def perm(x, n, *keys):
        for r in range(32):
            y = (spark_hash(seed32, *keys, np.int32(r)) % n - x) % n
            if spark_hash(seed32, *keys, np.int32(r), max(x, y)) % 2:
                x = y
        return x

    lists, blocks = [], []
    for name in names:
        own = [k for k, r in enumerate(rows) if r[2] == name and r[3]]
        many = max(sum(r[2] == name for r in rows) // 2048, 1)
        key = lambda k: spark_hash(rows[k][1]) if rows[k][1] is not None else 42
        own.sort(key=lambda k: (spark_hash(seed32, "order", rows[k][0], key(k)) % many, rows[k][0] is not None, rows[k][0] or 0, key(k), rows[k][3], k))
        words = [k for k in own for _ in range(rows[k][3])]
        blocks.append([words[a : a + block] for a in range(0, len(words), block)])
        lists.append([])
    for k, b in enumerate(blocks):  # slots until the target is reached, the last one cut
        lack, slot = min(math.floor(target[k] + 0.5), most * z[k]), 0
        while lack > 0:
            got = b[perm(slot % len(b), len(b), k, slot // len(b))][:lack]
            lists[k].append(got)
            lack, slot = lack - len(got), slot + 1
    sizes = [len(x) for x in lists]
    ends, drawn = np.cumsum(sizes), Counter()
    for place in range(sum(sizes)):
        drawn[place // shard, int(np.searchsorted(ends, spark_hash(seed32, "draw", place) % sum(sizes), side="right"))] += 1
    taken = Counter(w for x in lists for part in x for w in part)
    return [(r[0], r[3], z[names.index(r[2])], target[names.index(r[2])], taken[k]) for k, r in enumerate(rows)], drawn, lists


MIXED = [(i, t, s) for k, (i, t) in enumerate(ODD) for s in ("b", None, "", "é")[k % 4 : k % 4 + 2]] + [(300 + k, "tiny words here " * (k % 5), "small") for k in range(9)]


@pytest.mark.parametrize("block, shard", [(256, 1024), (16, 32), (7, 5)])
def test_mixing_equals_lists(spark, block, shard):
    df = spark.createDataFrame([(*r, "x") for r in MIXED], "doc_id long, text string, source string, size string")
    rows, found, pieces = mixing.mix(df, block=block, shard=shard)
    want, drawn, lists = mixed(MIXED, block, shard)
    taken = Counter()
    p = pieces.collect()
    for r in p:
        taken[r.row] += r.length
    z = {r.source: (r.z, r.target) for r in found.collect()}
    got = [(r.doc_id, r.size, *z[r.source], taken[r.row]) for r in rows.collect()]
    key = lambda r: (str(r[0]), *r[1:])
    rounded = lambda rs: sorted(((*r[:3], round(r[3], 6), r[4]) for r in rs), key=key)
    assert rounded(got) == rounded(want)
    # every slot once, gapless inside, each source's slots numbered from 0, none taken more than three times
    slot = defaultdict(list)
    for r in p:
        slot[r.s, r.slot].append((r.offset, r.length, r.shard))
    assert {k: sum(x[1] for x in v) for k, v in slot.items()} == {(s, i): len(w) for s, x in enumerate(lists) for i, w in enumerate(x)}
    for parts in slot.values():
        parts.sort()
        assert [x[0] for x in parts] == [sum(y[1] for y in parts[:k]) for k in range(len(parts))] and len({x[2] for x in parts}) == 1
    # shards have their size, and what wasn't settled is what was drawn
    counts = Counter((s_, k[0]) for k, v in slot.items() for s_ in {v[0][2]})
    per_shard = Counter()
    for (h, _), c in counts.items():
        per_shard[h] += c
    assert set(list(per_shard.values())[:-1]) <= {shard} or sorted(per_shard.values())[1:] == [shard] * (len(per_shard) - 1)
    moved = sum((drawn - counts).values())
    assert moved == sum((Counter({s: sum(c for (_, x), c in drawn.items() if x == s) for s in range(len(lists))}) - Counter({s: len(x) for s, x in enumerate(lists)})).values())
    again = mixing.mix(df.repartition(5), block=block, shard=shard)[2].groupBy("s", "slot").sum("length").collect()
    assert {(r[0], r[1]): r[2] for r in again} == {k: sum(x[1] for x in v) for k, v in slot.items()}


def test_permutations(spark):
    for n in (1, 2, 3, 10, 97, 256):
        d = spark.range(n).selectExpr("id", f"{n}L as n").select("id", "n", mixing.permuted("id", "n", "13, 5L, n").alias("p"))
        rows = d.select("id", "p", mixing.permuted("p", "n", "13, 5L, n", back=True).alias("b")).collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.b == r.id for r in rows)
        assert n < 97 or sum(r.p == r.id for r in rows) < 8


def test_op13(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "source"]).to_pydict()
    rows = list(zip(t["doc_id"], t["text"], t["source"]))
    want, _, _ = mixed(rows)
    got = mixing.op13(spark, SF).collect()
    rounded = lambda rs: sorted((*r[:3], round(r[3], 6), r[4]) for r in rs)
    assert rounded(tuple(r) for r in got) == rounded(want)
    by = defaultdict(list)
    for (i, _, s), r in zip(rows, want):
        by[s].append(r)
    assert all(abs(sum(r[4] for r in v) - v[0][3]) <= 0.5 and max(r[4] - 3 * r[1] for r in v) <= 0 for v in by.values())


_whole = {}


def aligned(texts):
    """(groups as lists of ids, links of occurrences) of each text, from whole encodings, sign by sign; None without tokens."""
    if not _whole:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        _whole["a"], _whole["b"] = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        _whole["a"].encode_special_tokens = True
        _whole["back"] = {c: bytes([b]) for c, b in crosswalk.byte_letters().items()}
    a, b, back = _whole["a"], _whole["b"], _whole["back"]
    for t in texts:
        if not t:
            yield None
            continue
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ba = [b"".join(back[c] for c in a.id_to_token(i)) for i in ia]
        pieces = [b.id_to_piece(i) for i in ib]
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("\u2581", " ").encode() for p in pieces]
        if b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            yield None
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups = {e: ([], []) for e in sorted({*ends_a} & {*ends_b})}
        order = list(groups)
        for side, (ids, ends) in enumerate(((ia, ends_a), (ib, ends_b))):
            k = 0
            for i, e in zip(ids, ends):
                while order[k] < e:
                    k += 1
                groups[order[k]][side].append(i)
        yield list(groups.values())


def crosswalked(rows):
    """Rows of op12 for rows (doc_id, text)."""
    found = list(aligned(t for _, t in rows))
    held, links = Counter(), []
    for g in found:
        links.append([(x, y) for a, b in g or () for x in a for y in b])
        held.update(set(links[-1]))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    for (i, _), g, ls in zip(rows, found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or ())
        yield (i, sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), len(ls), sum(held[p] == top[p[0]] for p in ls), sum(held[p] for p in ls), sha(text) if g else "")


def test_crosswalk_equals_whole_encodings(spark, monkeypatch):
    rng = np.random.default_rng(12)
    signs = list(" \n\t\r'ab1.é") + ["  ", "\n\n", " \n", "\u3000", "\x85", "\u200b", "'s", "the", " the", "你好", "😀", "\x1c", "\u2028", "ﬁ", "e\u0301", "<0x41>", "<s>", "<|endoftext|>", "==="]
    rows = [(k, "".join(rng.choice(signs, int(rng.integers(0, 40))))) for k in range(600)]
    rows += [(700, "a\u2581b and more"), (701, "fine then \u2581"), (702, " \nabc"), (703, "\nabc"), (704, "a \nabc\nabc abc"), (705, "xyz " * 3000), (706, "=" * 5000), (707, "x\n" * 3000), (None, "no id"), *ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple(map(str, r))
    want = sorted(crosswalked(rows), key=key)
    for expanded, run in ((4_000_000, 12_000_000), (50, 3_000)):
        monkeypatch.setattr(crosswalk, "EXPANDED", expanded)
        encoded = crosswalk.encode(df)
        assert sorted(map(tuple, crosswalk.scored(encoded, crosswalk.pair_counts(encoded)).collect()), key=key) == want
    links = Counter((i, a, b) for (i, _), g in zip(rows, aligned(t for _, t in rows)) for x, y in g or () for a in x for b in y)
    got = Counter()
    for r in crosswalk.document_links(encoded).collect():
        got[r.doc_id, r.a, r.b] += r.times
    assert got == links


def test_aligner_in_small_runs():
    """Runs, slices of links and a cache that is emptied between runs change nothing."""
    texts = [t for _, t in ODD if t] + ["one two three", "two\nthree  four "] * 3
    old = crosswalk.KEPT, crosswalk.EXPANDED
    try:
        crosswalk.KEPT, crosswalk.EXPANDED = 2, 7
        m = crosswalk.Aligner()
        got = [crosswalk._run(m, 0, [0], [t]) for t in texts]
    finally:
        crosswalk.KEPT, crosswalk.EXPANDED = old
    whole = crosswalk._run(crosswalk.Aligner(), 0, [0] * len(texts), texts)
    for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"):
        assert [r[k][0] for r in got] == whole[k]
    total = Counter()
    for r in got:
        total.update({(a, b): n for a, b, n in zip(r["a"].tolist(), r["b"].tolist(), r["n_docs"].tolist())})
    assert total == {(a, b): n for a, b, n in zip(whole["a"].tolist(), whole["b"].tolist(), whole["n_docs"].tolist())}


def test_op12(spark, docs):
    assert sorted(map(tuple, crosswalk.op12(spark, SF).collect())) == sorted(crosswalked(docs))


def test_pieces_of_any_length():
    """Slices that overlap give tiktoken's ids; memory stays with the slices."""
    import resource

    import tiktoken

    c = bpe.Codec()
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})._encode_single_piece
    rng = np.random.default_rng(21)
    for n in (65, 66, 96, 97, 128, 300, 2000):
        for signs in ("ab", "=-", "aehlnorst", "abcdefghijklmnopqrstuvwxyz", "éüõa", "0123456789", "你好世界", "=", "a", "\u00a0 "):
            word = "".join(rng.choice(list(signs), n)).encode()
            for width in (bpe.SHORT, 8):
                assert np.frombuffer(c.contract_sliced(word, width), "<i4").tolist() == list(want(word))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for word in (b"=" * 3_000_000, b"-=" * 500_000):
        got = np.frombuffer(c.contract_sliced(word), "<i4")
        assert got.tolist() == list(want(word))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000
