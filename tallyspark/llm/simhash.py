"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then Hamming verification.

Two fingerprints of 64 bits that differ in at most ``max_bits`` places agree on at least ``blocks - max_bits`` of their
blocks, so every choice of that many blocks is a bucket key and each close pair meets in a bucket. More blocks make
longer keys, so their number follows the number of fingerprints; the links are the same. Equal fingerprints are one node
before any bucket is made, and only nodes that share a bucket are sent on with their fingerprint. A bucket of more than ``tile`` fingerprints is dealt to tasks as pairs of tiles,
so no task holds an unbounded bucket; each task compares its tile exactly and returns only a spanning forest of links.

For similarities well below that (0.8 of the five-word shingles) one word in fifty may differ, and shingle fingerprints
share no block. ``similar_components`` therefore makes two fingerprints of 1024 bits: one of the distinct words, whose
36 blocks of 28 bits are the bucket keys, so long that unlike documents seldom meet, and one of the distinct shingles,
whose Hamming distance decides. At a similarity of 0.8 it is 155 bits in the mean with a deviation of 11, at 0.7 it is 196.

Defined cases: null or empty text has fingerprint 0 and links like any other; rows with a null doc_id get a
fingerprint and no component; repeated rows get equal rows; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, packed, stage, with_key

SEED = 42
WIDE = [f"f{i}" for i in range(16)]
# Odd multipliers that stretch one hash to as many as wanted.
FOLD = np.uint64(0xBF58476D1CE4E5B9)
STRETCH = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) for i in range(len(WIDE))], np.uint64)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n, digest = len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter((digest(g, SEED) for g in grams), np.uint64, n - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += bit_counts(h[i : i + (1 << 15), None].astype(">u8"))
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's bits as a signed long."""

    def each(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def block_masks(blocks: int, same: int) -> list[int]:
    """One mask for each choice of `same` blocks out of `blocks` nearly equal blocks of 64 bits."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, same)]


def forest(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among rows of equal key; rows come sorted by key. Pairs are compared shift by shift."""
    label, root, edges = np.arange(len(fps)), {}, []

    def top(x):
        while x in root:
            x = root[x]
        return x

    ends = np.searchsorted(keys, keys, side="right")
    rows, shift = np.arange(len(fps)), 1
    while len(rows := rows[rows + shift < ends[rows]]):
        other = rows + shift
        rows_apart = label[rows] != label[other]
        bits = np.bitwise_count(fps[rows[rows_apart]] ^ fps[other[rows_apart]])
        close = rows_apart.copy()
        close[rows_apart] = (bits if bits.ndim == 1 else bits.sum(axis=1)) <= max_bits
        if close.any():
            for i, j in zip(rows[close].tolist(), other[close].tolist()):
                if (a := top(i)) != (b := top(j)):
                    root[max(a, b)] = min(a, b)
                    edges.append((i, j))
            moved = {x: top(x) for x in root}
            old, new = np.fromiter(moved, np.int64, len(moved)), np.fromiter(moved.values(), np.int64, len(moved))
            whole = np.arange(len(fps))
            whole[old] = new
            label = whole
        shift += 1
    return edges


def blocks_for(n: int, max_bits: int) -> int:
    """Blocks so that a key is about as long as the number of fingerprints is in bits: 21, 27 or 32 bits at 4 of 64."""
    return max_bits + 2 + (n > 1 << 24) + (n > 1 << 29)


def links(nodes: DataFrame, max_bits: int = 4, blocks: int | None = None, tile: int = 4096) -> DataFrame:
    """nodes(fp, rep), one row a fingerprint -> edges(a, b) between reps that span all links of at most max_bits bits."""
    blocks = blocks or blocks_for(nodes.count(), max_bits)
    masks = block_masks(blocks, blocks - max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("rep", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)))).alias("x")).select("x.c", "x.k", "rep")
    return bucket_links(keyed, nodes, ["fp"], max_bits, tile)


def bucket_links(keyed: DataFrame, nodes: DataFrame, fp: list[str], max_bits: int, tile: int) -> DataFrame:
    """keyed(c, k, rep): nodes in their buckets (c, k), nodes(rep, *fp) -> edges(a, b) that span the links of each bucket."""
    sizes = keyed.groupBy("c", "k").count().where("count > 1").select("c", "k", F.ceil(F.col("count") / tile).alias("tiles"))
    met = keyed.join(sizes, ["c", "k"]).join(nodes.select("rep", *fp), "rep")
    dealt = met.withColumn("t", F.pmod(F.xxhash64(*fp), F.col("tiles")))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select(F.xxhash64("c", "k", F.least("t", "o"), F.greatest("t", "o")).alias("bucket"), "rep", *fp)
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", *fp)

    def each(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            b, r, *f = (np.concatenate(x) for x in zip(*held))
            f = (f[0] if len(f) == 1 else np.stack(f, axis=1)).view(np.uint64)
            found = forest(b, f, max_bits)
            i, j = np.array(found, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(r[i]), pa.array(r[j])], ["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            b = cols[0]
            if len(b) == 0:
                continue
            if held and held[-1][0][-1] != b[-1]:  # a bucket ends here: all before it is complete
                cut = int(np.searchsorted(b, b[-1]))
                held.append(tuple(c[:cut] for c in cols))
                yield flush()
                held, cols = [], [c[cut:] for c in cols]
            held.append(tuple(cols))
        if held:
            yield flush()

    return dealt.mapInArrow(each, "a long, b long")


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many rows of a matrix of 64-bit words have each bit."""
    bits = np.unpackbits(h.view(np.uint8), axis=1)
    whole = len(bits) - len(bits) % 255
    runs = bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8)  # a byte holds 255 ones
    return runs.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def wide_fingerprint(features: set[bytes], words: int) -> np.ndarray:
    """SimHash of a set in so many words of 64 bits: each feature's hash is stretched by multiplying and folding."""
    if not features:
        return np.zeros(words, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(f, SEED) for f in features), np.uint64, len(features))
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, len(h), 4080):
        g = h[i : i + 4080, None] * STRETCH[:words]
        g ^= g >> np.uint64(29)
        g *= FOLD
        g ^= g >> np.uint64(32)
        ones += bit_counts(g)
    return np.packbits(ones * 2 > len(h)).view(np.uint64)


def wide_nodes(docs: DataFrame, shingle: int = 5, blocks: int = 36, width: int = 28) -> DataFrame:
    """(doc_id, tkey, blocks, f0 ...): block keys from the distinct words, the fingerprint of the distinct shingles."""
    powers = 1 << np.arange(width)

    def each(batches):
        for b in batches:
            keys, fps = [], []
            for t in b.column(1).to_pylist():
                words = (t or "").encode().lower().split()
                bits = np.unpackbits(wide_fingerprint(set(words), len(WIDE)).view(np.uint8))[: blocks * width]
                keys.append((bits.reshape(blocks, width) @ powers).tolist())
                fps.append(wide_fingerprint({b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set(), len(WIDE)))
            fp = np.array(fps, np.uint64).reshape(-1, len(WIDE)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.list_(pa.int32())), *(pa.array(np.ascontiguousarray(c)) for c in fp.T)], ["doc_id", "tkey", "blocks", *WIDE])

    return with_key(docs).mapInArrow(each, "doc_id long, tkey long, blocks array<int>, " + ", ".join(f"{f} long" for f in WIDE))


def similar_components(docs: DataFrame, shingle: int = 5, max_bits: int = 178, tile: int = 4096) -> DataFrame:
    """(doc_id, tkey, component_id) of documents whose sets of word shingles are alike.

    178 of 1024 bits is two deviations above the mean distance at a similarity of 0.8. Links are transitive: a component
    may hold documents that are alike only by way of others, and keep_first() keeps one row of the whole component.
    """
    rows = stage(wide_nodes(docs, shingle), "wide")
    nodes = rows.where("doc_id is not null").groupBy("blocks", *WIDE).agg(F.min("doc_id").alias("rep"))
    nodes = stage(nodes, "wide-nodes")
    keyed = nodes.select(F.posexplode("blocks").alias("c", "k"), "rep")
    found = components(bucket_links(keyed, nodes, WIDE, max_bits, tile))
    of_node = nodes.join(found, nodes.rep == found.node, "left").select("blocks", *WIDE, F.coalesce("component", "rep").alias("component_id"))
    return rows.join(of_node, ["blocks", *WIDE], "left").select("doc_id", "tkey", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; rows without a doc_id and repeated rows stay."""
    losers = found.where("doc_id <> component_id").select("doc_id", "tkey").distinct()
    return packed(docs).join(losers, ["doc_id", "tkey"], "left_anti").select("row.*")


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int | None = None, tile: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the smallest doc_id reachable over links."""
    fps = stage(fingerprints(docs, shingle), "fp")
    nodes = stage(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = components(links(nodes, max_bits, blocks, tile))
    of_fp = nodes.join(found, nodes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of_fp, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op7(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
