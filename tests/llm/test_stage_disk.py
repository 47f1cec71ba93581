"""What a written stage leaves on disk, and rows of equal ids in the substring dedup, whose anchors hold little of a row's key."""

import os
from collections import Counter

from pyspark.sql import functions as F
from tallyspark.llm import substrings
from tallyspark.llm.common import TIDY, stage


def shuffle_bytes(spark) -> int:
    n = 0
    for top in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString():
        for folder, _, names in os.walk(top):
            for f in names:
                try:
                    n += os.path.getsize(f"{folder}/{f}") if f.startswith("shuffle_") else 0
                except OSError:  # removed meanwhile
                    pass
    return n


def test_a_stage_frees_its_shuffles(spark):
    before, held = spark.conf.get(TIDY), shuffle_bytes(spark)
    kept = stage(spark.range(400_000).withColumn("x", F.xxhash64("id")).repartition("x").sortWithinPartitions("x"), "tidy")
    assert shuffle_bytes(spark) < held + 1_000_000  # the rows took 6 MB of shuffle files
    assert kept.count() == 400_000 and spark.conf.get(TIDY) == before


def test_rows_of_equal_id_keep_their_own_windows(spark):
    w = [f"w{i}" for i in range(400)]
    rows = [(1, w[:120]), (2, w[60:200]), (2, ["x"] + w[60:200]), (2, [*"abcdefgh"] * 20), (3, ["y"] * 7 + w[100:230]), (3, w[:55])]
    got = substrings.remove_repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first[tuple(t[k : k + 50])] = min(first.get(tuple(t[k : k + 50]), i), i)
    want = Counter()
    for i, t in rows:
        gone = {k + j for k in range(len(t) - 49) if first[tuple(t[k : k + 50])] < i for j in range(50)}
        want[i, len(t), len(gone)] += 1
    assert Counter((r.doc_id, r._n_words, r._n_removed) for r in got) == want
