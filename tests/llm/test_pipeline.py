"""The corpus pipeline: what each stage must do on small tables."""

import re

import corpus_pipeline as P
from tallyspark.llm import simhash

SF = "/root/testdata/sf0.001"


def stages(spark, rows=None):
    docs = rows if rows is not None else spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in P.STAGES:
        out.append(f(spark, out[-1], SF).persist())
    return out


def test_whole_run(spark):
    docs, *got = stages(spark)
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    for g in got[:-1]:
        assert g.columns == docs.columns
    ids = [{r.doc_id for r in g.select("doc_id").collect()} for g in [docs, *got]]
    assert ids[0] >= ids[1] == ids[2] >= ids[3] == ids[4] == ids[5] and len(ids[1]) > 0.8 * len(ids[0])
    assert P.run(spark, SF).count() == got[-1].count()


def test_copies_and_clean_rows(spark):
    base = [" ".join(f"{a}{k * 7 % 91}{b}" for k, b in enumerate("abcdefghijklmnopqrstuvwxyz" * 4)) for a in "pqrs"]
    edited = base[0].split(" ")
    edited[50] = "other"
    rows = [(1, base[0]), (2, base[0]), (3, " ".join(edited)), (4, base[1]), (5, base[2]), (6, None), (7, ""), (None, base[0]), (8, base[3]), (8, base[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = P.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in left if r.doc_id) == [1, 4, 5, 6, 8, 8] and sum(r.doc_id is None for r in left) == 1


def test_recall_and_precision_at_the_similarity(spark):
    """All pairs of documents whose five-word shingles are 0.8 alike or more, hot shingles included: nine of ten at least end
    in one component; documents of one component are alike by way of some other in it."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t).split() for _, t in rows]
    sets = [frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in low]
    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    alike, best = [], {}
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if len(sets[a]) < 0.6 * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            j = both / (len(sets[a]) + len(sets[b]) - both) if both else float(sets[a] == sets[b])
            if j >= 0.6:
                best.setdefault(a, {})[b] = best.setdefault(b, {})[a] = j
            if j >= 0.8:
                alike.append((rows[a][0], rows[b][0]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    comp = {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()}
    assert len(alike) > 30 and sum(comp[a] == comp[b] for a, b in alike) >= 0.95 * len(alike)
    ids = [i for i, _ in rows]
    together = [k for k in range(len(rows)) if any(comp[ids[m]] == comp[ids[k]] for m in best.get(k, ())) or sum(c == comp[ids[k]] for c in comp.values()) > 1]
    fit = [max((j for m, j in best.get(k, {}).items() if comp[ids[m]] == comp[ids[k]]), default=0) for k in together]
    assert all(f >= 0.6 for f in fit) and sum(f >= 0.75 for f in fit) >= 0.95 * len(fit)


def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows and columns named like the stages' own."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a\n\nb", None, "s", 4), (3, "a\n\nb", None, "s", 4), (None, "no id here", "en", None, 10), (None, "no id here", "en", None, 10)]
    rows += [(4, long, "en", "s", len(long)), (5, long + " tail", "en", "s", len(long) + 5), (6, "x" * 20_000, "de", "s", 20_000)] + [(10 + i, f"shared line\nown {i}", "en", "s", 17) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "1 AS _doc", "2 AS _t", "3 AS _tkey", "4 AS tkey", "5 AS row", "6 AS keep", "7 AS spots", "8 AS _score", "9 AS _n_dropped", "10 AS component_id")


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    n = docs.count()
    for name, f in P.STAGES[:-1]:
        got = f(spark, docs, SF)
        assert got.columns == list(P.COLUMNS), name
        ids = [r.doc_id for r in got.collect()]
        assert ids.count(None) == 2 and ids.count(3) == 2 and (len(ids) == n or name == "near_dedup" and 5 not in ids), name
    kept = {r.doc_id: r for r in P.drop_lines(spark, docs, SF).where("doc_id is not null").collect()}
    assert kept[10].text == "shared line\nown 0" and kept[11].text == "own 1" and kept[11].n_chars == 5
    assert P.drop_passages(spark, docs, SF).where("doc_id = 5").first().text.split(" ")[-1] == "tail"
    packed = P.pack(spark, docs, SF).collect()
    assert sum(r.length for r in packed if r.doc_id == 3) == 2 * packed[[r.doc_id for r in packed].index(3)].doc_tokens


def test_stages_on_an_empty_table(spark):
    docs = awkward(spark).limit(0)
    assert all(f(spark, docs, SF).count() == 0 for _, f in P.STAGES)
