"""Quality rules with thresholds that adapt to each language and source; DataFrame functions only.

Each document gets counts from its whole text. Ratios of them, all within 0 and 1, of the documents that pass the base rule
go into quantile sketches for every (lang, source): counts by bins of 1/4096, which merge by adding, to a sketch for each
language and one for all. Their quantiles are exact to a bin and the same in every run.

Junk shows as a second crowd far above the first. So a sketch's fence lies in the widest empty stretch above its third
quartile, a third of the way up, if that is wider than all that lies between the median and it and at least ``GAP`` bins;
a sketch without one has no fence. A group's fence is then shrunk to its language's, and that to the one of all, by the
number of documents that stand behind each against ``belief``. Documents are joined to the fences of their group and
filtered.

Defined cases: null or empty text has no word and fails the base rule; null lang or source is a group of its own; rows
with equal ids are judged one by one; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import ASCII_SPACE, documents, stage

SYMBOLS = "#*$%&|<>"
BINS = 4096
#: Bins in which no document is, at least, between what is usual and what is not; documents that a wider sketch stands for.
GAP, BELIEF = 256, 800
#: ratio -> (count, what it is a share of)
RATIOS = {
    "symbol_ratio": ("n_symbols", "n_symbols + n_words"),
    # a few lines more in the divisor, so that one repeat among three lines is no verdict
    "dup_line_ratio": ("n_dup_lines", "n_lines + 4"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "echo_ratio": ("n_echo", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
}
#: The base rule, which needs no sketch.
FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"

#: Positions covered by windows of 8 words that occur twice or more; w: hashes of the words. array(x) with a lambda
#: over it names a value, so that it is computed once.
REPEATS = """
transform(array(transform(sequence(1, size(w) - 7), i -> xxhash64(slice(w, i, 8)))), h ->
  if(size(array_distinct(h)) = size(h), 0L,
    transform(array(array_sort(transform(h, (x, i) -> struct(x, i)))), s ->
      transform(array(array_sort(transform(filter(s, (r, i) -> r.x = get(s, i - 1).x or r.x = get(s, i + 1).x), r -> r.i))), p ->
        aggregate(transform(p, (a, i) -> cast(least(8, coalesce(get(p, i + 1) - a, 8)) as bigint)), 0L, (t, a) -> t + a))[0])[0]))[0]
"""


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) and the counts of each row's whole text."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("t"))
    d = d.select(
        "doc_id",
        "lang",
        "source",
        F.char_length(F.translate("t", ASCII_SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        F.expr(r"transform(array(filter(split(t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')), l -> struct(size(l) as n, size(l) - size(array_distinct(l)) as d))[0]").alias("l"),
        F.expr(r"transform(filter(split(t, '[\\x20\\x09-\\x0D]+'), x -> x <> ''), x -> xxhash64(x))").alias("w"),
    )
    return d.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.d").cast("long").alias("n_dup_lines"),
        F.expr(f"if(size(w) < 8, 0L, {REPEATS})").alias("n_repeat_words"),
        F.col("l.n").cast("long").alias("n_lines"),
        "n_upper",
        F.expr("size(filter(w, (x, i) -> x = get(w, i - 1)))").cast("long").alias("n_echo"),
    )


def with_bins(counted: DataFrame) -> DataFrame:
    """counts() with the bin of each ratio."""
    return counted.select("*", *(F.expr(f"{BINS} * {n} div greatest({of}, 1)").alias(k) for k, (n, of) in RATIOS.items()))


def sketches(binned: DataFrame) -> DataFrame:
    """(lang, source, ratio, bin, n): the quantile sketches of every (lang, source), of rows that pass the base rule."""
    binned = binned.where(f"NOT {FAILED}")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("ratio"), F.col(k).alias("bin")) for k in RATIOS)))
    return binned.select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.ratio", "x.bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))


def bounds(sketch: DataFrame, *keys: str) -> DataFrame:
    """(*keys, ratio, size, fence) from sketches: where the widest empty stretch of the upper quarter is, else BINS."""
    w = W.partitionBy(*keys, "ratio")
    run = sketch.withColumn("up_to", F.sum("n").over(w.orderBy("bin"))).withColumn("size", F.sum("n").over(w)).withColumn("width", F.lead("bin").over(w.orderBy("bin")) - F.col("bin"))
    first = lambda k: F.min(F.when(4 * F.col("up_to") >= k * F.col("size"), F.col("bin"))).over(w)
    run = run.withColumn("median", first(2)).withColumn("q3", first(3))
    wide = (F.col("bin") >= F.col("q3")) & (F.col("width") >= GAP) & (F.col("width") > F.col("bin") - F.col("median"))
    best = F.max(F.when(wide, F.struct("width", (-F.col("bin")).alias("low"))))
    found = run.groupBy(*keys, "ratio").agg(F.first("size").alias("size"), best.alias("x"))
    return found.select(*keys, "ratio", "size", F.coalesce(F.expr("x.width div 3 - x.low"), F.lit(BINS)).alias("fence"))


def fences(binned: DataFrame, belief: int = BELIEF) -> DataFrame:
    """(lang, source, n_group, <ratio>_max ...): one row for each language and source, in bins."""
    own = stage(sketches(binned), "sketches")
    a, b, c = (bounds(merged(own, *keys), *keys) for keys in (("lang", "source"), ("lang",), ()))
    b = b.select(F.col("lang").alias("l"), F.col("ratio").alias("r"), F.col("size").alias("lang_size"), F.col("fence").alias("lang_fence"))
    c = c.select(F.col("ratio").alias("all_ratio"), F.col("fence").alias("all_fence"))
    both = a.join(b, F.col("lang").eqNullSafe(F.col("l")) & (F.col("ratio") == F.col("r"))).join(c, F.col("ratio") == F.col("all_ratio"))
    both = both.withColumn("wide", F.expr(f"(lang_size * lang_fence + {belief} * all_fence) div (lang_size + {belief})"))
    fence = F.expr(f"(size * fence + {belief} * wide) div (size + {belief})")
    return both.groupBy("lang", "source").agg(F.first("size").alias("n_group"), *(F.max(F.when(F.col("ratio") == k, fence)).alias(f"{k}_max") for k in RATIOS))


def judge(docs: DataFrame, belief: int = BELIEF) -> DataFrame:
    """counts() of each row with its ratios' bins, base_failed, kept and the first reason against it."""
    binned = with_bins(stage(counts(docs), "counts"))
    limits = fences(binned, belief)
    both = binned.alias("d").join(limits.alias("f"), F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source")), "left")
    failed = F.expr(FAILED)
    reason = F.when(failed, "base")
    for k in RATIOS:
        reason = reason.when(F.col(f"d.{k}") > F.col(f"{k}_max"), k)
    return both.select("d.*", failed.alias("base_failed"), reason.isNull().alias("kept"), reason.alias("reason"))


def op9(spark, sf_dir: str) -> DataFrame:
    found = judge(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _bins(name: str) -> str:
    n, of = RATIOS[name]
    return f"{BINS} * {n} // greatest({of}, 1)"


#: op9 for DuckDB.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
starts AS (SELECT rid, i, md5(array_to_string(w[i:i + 7], ' ')) AS h FROM w, unnest(range(1, len(w) - 6)) AS u(i)),
twice AS (SELECT rid, i FROM starts QUALIFY count(*) OVER (PARTITION BY rid, h) > 1),
places AS (SELECT rid, i FROM w, unnest(range(1, len(w) + 1)) AS u(i)),
covered AS (SELECT p.rid, max(t.i) OVER (PARTITION BY p.rid ORDER BY p.i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) IS NOT NULL AS c FROM places p LEFT JOIN twice t ON t.rid = p.rid AND t.i = p.i),
repeats AS (SELECT rid, count(*) FILTER (WHERE c) AS n FROM covered GROUP BY rid),
counted AS (SELECT d.rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
  length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
  coalesce(r.n, 0) AS n_repeat_words, len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_echo
  FROM d JOIN w ON w.rid = d.rid LEFT JOIN repeats r ON r.rid = d.rid),
lined AS (SELECT *, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines FROM counted),
binned AS (SELECT *, {", ".join(f"{_bins(k)} AS {k}" for k in RATIOS)} FROM lined),
long AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, {k} AS bin FROM binned WHERE NOT {FAILED}" for k in RATIOS)}),
levels AS (SELECT 'own' AS level, lang, source, ratio, bin FROM long UNION ALL SELECT 'lang', lang, NULL, ratio, bin FROM long UNION ALL SELECT 'all', NULL, NULL, ratio, bin FROM long),
sized AS (SELECT level, lang, source, ratio, count(*) AS size, quantile_disc(bin, 0.5) AS median, quantile_disc(bin, 0.75) AS q3 FROM levels GROUP BY ALL),
steps AS (SELECT *, lead(bin) OVER (PARTITION BY level, lang, source, ratio ORDER BY bin) - bin AS width FROM (SELECT DISTINCT level, lang, source, ratio, bin FROM levels)),
gaps AS (SELECT s.level, s.lang, s.source, s.ratio, any_value(size) AS size, coalesce(arg_max(p.bin + width // 3, width * 10000 - p.bin) FILTER (WHERE p.bin >= q3 AND width >= {GAP} AND width > p.bin - median), {BINS}) AS fence
 FROM sized s JOIN steps p ON p.level = s.level AND p.ratio = s.ratio AND p.lang IS NOT DISTINCT FROM s.lang AND p.source IS NOT DISTINCT FROM s.source GROUP BY ALL),
wide AS (SELECT a.ratio, l.lang, (l.size * l.fence + {BELIEF} * a.fence) // (l.size + {BELIEF}) AS fence FROM gaps l JOIN gaps a ON a.ratio = l.ratio WHERE l.level = 'lang' AND a.level = 'all'),
chosen AS (SELECT o.lang, o.source, o.ratio, (o.size * o.fence + {BELIEF} * w.fence) // (o.size + {BELIEF}) AS fence FROM gaps o JOIN wide w ON w.ratio = o.ratio AND w.lang IS NOT DISTINCT FROM o.lang WHERE o.level = 'own'),
over AS (SELECT b.rid, coalesce(bool_or(CASE c.ratio {" ".join(f"WHEN '{k}' THEN b.{k}" for k in RATIOS)} END > c.fence), false) AS out FROM binned b LEFT JOIN chosen c ON c.lang IS NOT DISTINCT FROM b.lang AND c.source IS NOT DISTINCT FROM b.source GROUP BY b.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {FAILED} AS base_failed, NOT ({FAILED} OR out) AS kept
FROM binned b JOIN over o ON o.rid = b.rid"""
