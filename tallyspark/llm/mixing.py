"""Mixing sources to target weights; DataFrame functions only.

The words of a source, its documents in a fixed order, are packed into blocks of ``BLOCK`` words, the last one short. The
mix is as many block slots as the targets need, dealt to output shards of ``SHARD`` slots. For every shard a multinomial
count of each source is drawn, slot by slot, with the sources' shares as probabilities. Counts that draw a source more
often than its target asks for are settled at the end of its last shards: those slots go to the sources that were drawn
too seldom, so totals are exact. A source's slots are numbered through its shards; slot i of a source of n blocks is the
(i mod n)-th block of the (i div n)-th pass over it, in the order of a pseudorandom permutation of the indices 0 to n-1,
another one for each pass. Slots and blocks are then joined by (source, index). The last slot of a source is cut, so that
a source gives its target to the word, and no block is taken more than ``most`` times.

A permutation is computed index by index ("swap or not": each round mirrors the index at a keyed point, or not, by a hash
of the pair), for any n and in both directions, so none is stored or sorted. Prefix sums go over two levels, so that no
source is one task's; ranges are met by joins on blocks of 4096 numbers. Rerun on the same rows, the mix is the same.

Targets: source i in code point order, null last, weighs ``weights[i mod 3]``; weights share all words. A source's target
stops at ``most`` times its size and what is over is shared anew by weight: the level at which it fits is found by one
pass over the sources in order of limit by weight.

Defined cases: null or empty text, or one of white space, has no word and is never taken; a null source is a source, and
so is one without words, whose target is 0; rows that repeat a doc_id are taken one by one, and equal rows share one
place in the order, so that only which is which is open; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import ASCII_SPACE, documents, stage

BLOCK, SHARD, ROUNDS, SEED = 256, 1024, 32, 13
WEIGHTS, MOST = (1, 2, 3), 3
#: Numbers of a range that a join key stands for; rows of one source that are ordered together; totals summed together.
WIDE, BUCKET, SPAN = 4096, 2048, 4096
_space = r"[\x20\x09-\x0D]"
_word = r"[^\x20\x09-\x0D]"


def n_words(text: Column) -> Column:
    """Words of a text: each becomes one letter, with the white space around it."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), f"{_space}*+{_word}++{_space}*+", "x")
    return F.octet_length(F.translate(letters, ASCII_SPACE, "")).cast("long")


def permuted(x: str, n: str, keys: str, rounds: int = ROUNDS, back: bool = False) -> Column:
    """Index x in 0 .. n-1 by the pseudorandom permutation of `keys` (expressions, comma-separated), or back."""
    order = f"sequence({rounds - 1}, 0)" if back else f"sequence(0, {rounds - 1})"
    mirror = f"pmod(pmod(xxhash64({keys}, r), {n}) - x, {n})"
    return F.expr(f"aggregate({order}, {x}, (x, r) -> if(xxhash64({keys}, r, greatest(x, {mirror})) % 2 = 0, x, {mirror}))")


def before(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows with `before`: the sum of `value` over rows of equal keys and smaller `order`, whole numbers that are used once."""
    cut = rows.withColumn("_span", F.expr(f"{order} div {SPAN}"))
    whole = cut.groupBy(*keys, "_span").agg(F.sum(value).alias("_sum"))
    whole = whole.select(*keys, "_span", (F.sum("_sum").over(W.partitionBy(*keys).orderBy("_span")) - F.col("_sum")).alias("_base"))
    fine = cut.withColumn("_own", F.sum(value).over(W.partitionBy(*keys, "_span").orderBy(order)) - F.col(value))
    return fine.join(whole, [*keys, "_span"]).withColumn("before", F.col("_base") + F.col("_own")).drop("_span", "_base", "_own")


def located(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points(v, ...) with the columns of the range (low, high, ...) that v lies in: an equi-join on blocks of numbers."""
    many = ranges.where("high > low").withColumn("_part", F.explode(F.expr(f"sequence(low div {WIDE}, (high - 1) div {WIDE})")))
    return points.withColumn("_part", F.expr(f"v div {WIDE}")).join(many, "_part").where("v >= low and v < high").drop("_part", "low", "high")


def sized(docs: DataFrame) -> DataFrame:
    """(row, doc_id, tkey, source, size) of each row, written to the shared folder: texts are read once."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "source", n_words(F.col("text")).alias("size"))
    return stage(own, "sizes")


def sources(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """A row for each source: (source, s, n_docs, z, target, n, last, k, cut, low, high).

    s: its place in code point order; z: its words; n: its blocks, the last one of `last` words; k: the slots it gets, of
    which the last one lacks `cut` words; low, high: its range among all slots.
    """
    every = W.partitionBy()
    d = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("z"))
    d = d.withColumn("s", (F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1).cast("long"))
    d = d.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")).cast("decimal(38,0)")).withColumn("limit", (most * F.col("z")).cast("decimal(38,0)"))
    # in order of limit by weight, those in whose turn the rest, dealt by weight, is over their limit are at it
    turn = W.orderBy(F.col("limit") / F.col("w"), "s")
    d = d.withColumn("rest", F.sum("z").over(every) - F.sum("limit").over(turn) + F.col("limit")).withColumn("weigh", F.sum("w").over(every) - F.sum("w").over(turn) + F.col("w"))
    d = d.withColumn("full", F.col("limit") * F.col("weigh") < F.col("rest") * F.col("w"))
    open_ = lambda c: F.sum(F.when(~F.col("full"), F.col(c)).otherwise(0)).over(every)
    level = (F.sum("z").over(every) - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(every)).cast("double") / open_("w").cast("double")
    d = d.withColumn("target", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("w").cast("double") * level))
    d = d.withColumn("words", F.least(F.floor(F.col("target") + 0.5).cast("long"), most * F.col("z")))
    d = d.withColumn("n", F.expr(f"(z + {block - 1}) div {block}")).withColumn("last", F.col("z") - (F.col("n") - 1) * block)
    d = d.withColumn("pass", F.expr("if(z = 0, 0, words div z)")).withColumn("r", F.col("words") - F.col("pass") * F.col("z"))
    # where in the pass that isn't whole the short block comes, and how many slots give the r words still due
    d = d.withColumn("short", F.when(F.col("r") > 0, permuted("n - 1", "n", f"{seed}, s, pass", back=True))).withColumn("q", F.expr(f"(r + {block - 1}) div {block}"))
    hit = F.col("short") < F.col("q")
    d = d.withColumn("q", F.when(hit, F.expr(f"(r + {block} - last + {block - 1}) div {block}")).otherwise(F.col("q")))
    d = d.withColumn("cut", F.col("q") * block - F.when(hit, block - F.col("last")).otherwise(0) - F.col("r"))
    d = d.withColumn("k", F.col("pass") * F.col("n") + F.col("q"))
    d = d.withColumn("high", F.sum("k").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return stage(d.select("source", "s", "n_docs", "z", "target", "n", "last", "k", "cut", (F.col("high") - F.col("k")).alias("low"), "high"), "sources")


def slots(found: DataFrame, shard: int = SHARD, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(shard, s, slot, index, words): every block slot of the mix, its source, its number within the source, the block it
    takes and how many of its words."""
    spark = found.sparkSession
    total = found.agg(F.sum("k")).first()[0] or 0
    shards = spark.range(-(-total // shard)).withColumnRenamed("id", "shard")
    places = shards.select("shard", F.explode(F.expr(f"sequence(shard * {shard}, least((shard + 1) * {shard}, {total}L) - 1)")).alias("place"))
    draws = places.select("shard", F.expr(f"pmod(xxhash64({seed}, 'draw', place), {max(total, 1)}L)").alias("v"))
    drawn = located(draws, found.select("s", "k", "low", "high")).groupBy("shard", "s", "k").agg(F.count("*").alias("c"))
    drawn = stage(drawn, "draws")  # the multinomial counts of each shard

    # how often each source was drawn beyond its slots, or short of them, as ranges of numbers
    sums = found.join(drawn.groupBy("s").agg(F.sum("c").alias("got")), "s", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    sums = sums.withColumn("over", F.greatest(F.col("got") - F.col("k"), F.lit(0))).withColumn("lack", F.greatest(F.col("k") - F.col("got"), F.lit(0)))
    run = W.orderBy("s").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = sums.select("s", "got", "k", "lack", (F.sum("over").over(run) - F.col("over")).alias("first_over"), F.sum("lack").over(run).alias("high"))
    numbered = before(drawn.drop("k"), ["s"], "shard", "c").join(sums.select("s", "k", "first_over"), "s")
    numbered = numbered.select("shard", "s", "k", "first_over", F.explode(F.expr("sequence(before, before + c - 1)")).alias("slot"))
    own = numbered.where("slot < k").select("shard", "s", "slot")
    more = numbered.where("slot >= k").select("shard", (F.col("first_over") + F.col("slot") - F.col("k")).alias("v"))
    lacking = sums.select("s", "got", (F.col("high") - F.col("lack")).alias("from"), (F.col("high") - F.col("lack")).alias("low"), "high")
    settled = located(more, lacking).select("shard", "s", (F.col("got") + F.col("v") - F.col("from")).alias("slot"))
    both = own.unionByName(settled).join(found.select("s", "n", "last", "k", "cut"), "s")
    both = both.withColumn("index", permuted("slot % n", "n", f"{seed}, s, slot div n"))
    words = F.when(F.col("index") == F.col("n") - 1, F.col("last")).otherwise(block) - F.when(F.col("slot") == F.col("k") - 1, F.col("cut")).otherwise(0)
    return both.select("shard", "s", "slot", "index", words.alias("words"))


def blocks(rows: DataFrame, found: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(row, s, index, start, low, high): words low to high of block `index` of source s are those of a row from `start` on."""
    small = found.select(F.col("source").alias("_source"), "s", F.expr(f"greatest(n_docs div {BUCKET}, 1)").alias("_many"))
    own = rows.where("size > 0").join(small, F.col("source").eqNullSafe(F.col("_source")))
    own = own.select("row", "doc_id", "tkey", "size", "s", F.expr(f"pmod(xxhash64({seed}, 'order', doc_id, tkey), _many)").alias("bucket"))
    totals = before(own.groupBy("s", "bucket").agg(F.sum("size").alias("sum")), ["s"], "bucket", "sum")
    inner = W.partitionBy("s", "bucket").orderBy("doc_id", "tkey", "size", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = own.withColumn("_to", F.sum("size").over(inner)).join(totals.select("s", "bucket", "before"), ["s", "bucket"])
    placed = placed.select("row", "s", (F.col("before") + F.col("_to") - F.col("size")).alias("at"), (F.col("before") + F.col("_to")).alias("end"))
    each = placed.withColumn("index", F.explode(F.expr(f"sequence(at div {block}, (end - 1) div {block})")))
    first = F.col("index") * block
    return each.select("row", "s", "index", (F.greatest("at", first) - F.col("at")).alias("start"), (F.greatest("at", first) - first).alias("low"), (F.least("end", first + block) - first).alias("high"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, pieces): sized(), sources() and the mix: (shard, s, slot, index, offset, row, start, length), for
    each slot the words of each row in it, from word `start` of the row and at `offset` in the slot."""
    rows = sized(docs)
    found = sources(rows, weights, most, block, seed)
    taken = slots(found, shard, block, seed).join(blocks(rows, found, block, seed), ["s", "index"]).where("low < words")
    return rows, found, taken.select("shard", "s", "slot", "index", F.col("low").alias("offset"), "row", "start", (F.least("high", "words") - F.col("low")).alias("length"))


def op13(spark, sf_dir: str) -> DataFrame:
    rows, found, pieces = mix(documents(spark, sf_dir))
    sums = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    small = found.select(F.col("source").alias("_source"), F.col("z").alias("source_size"), "target")
    both = rows.join(small, F.col("source").eqNullSafe(F.col("_source"))).join(sums, "row", "left")
    return both.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
