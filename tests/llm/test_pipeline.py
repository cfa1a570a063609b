"""The corpus pipeline against a plain version of its stages, and its edge cases."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_narrow_the_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    named = dict(corpus_pipeline.STAGES)
    told = named["language_id"](spark, docs, SF)
    assert told.columns == docs.columns
    kept = {r.doc_id for r in told.collect()}
    letters = {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    assert kept <= letters and len(kept) >= 0.99 * len(letters)

    unique = named["exact_dedup"](spark, told, SF)
    best: dict = {}
    for i in kept:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), rows[i].text or "")
        best[key] = max(best.get(key, i), i)
    assert {r.doc_id for r in unique.collect()} == set(best.values())

    sparse = named["near_dedup"](spark, unique, SF)
    sets = {}
    for i in best.values():
        w = [x for x in re.split(r"[ \t\n\v\f\r]+", rows[i].text.lower()) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    left = {r.doc_id for r in sparse.collect()}
    group: dict = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    assert left == set(group.values())

    mixed = named["mix_sources"](spark, sparse, SF)
    assert mixed.columns == docs.columns
    times = mixed.groupBy("doc_id").count()
    assert times.agg(F.max("count")).first()[0] <= 2
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text)) for i in left)
    taken = sum(r["count"] * len(re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id].text)) for r in times.collect())
    assert 1.4 * words <= taken <= 1.5 * words

    tokens = named["tokenize"](spark, mixed, SF)
    got = tokens.select("doc_id", "n_tokens", "round_trip").collect()
    assert len(got) == mixed.count() and all(r.round_trip and r.n_tokens > 0 for r in got)


def test_stages_stand_hard_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    hard = spark.createDataFrame([(1, None, None, None, None), (None, "no id but words", "en", "a", 1), (2, "", "en", "a", 0), (3, "x", None, None, 1), (3, "x", None, None, 1)], schema)
    for table in (hard, hard.limit(0)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_language_stage_rejects_what_is_in_no_language(spark):
    import random

    rng = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = ["".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(400)) for _ in range(20)]
    planted = spark.createDataFrame([(-1 - i, t, None, "noise", len(t)) for i, t in enumerate(noise)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(planted), SF).collect()}
    assert sum(i < 0 for i in kept) <= 2
    letters = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert kept >= letters


def test_stages_stand_columns_named_like_their_own(spark):
    names = "score ambiguous loss lang_pred letter row mark size epochs times copy digest own own_mark own_size keep_id kept_id kept_mark first node key body of_source __digest __size __text".split()
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for n in names:
        docs = docs.withColumn(n, F.lit(f"<{n}>"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = out.select(*names).distinct().collect()
        assert [r.asDict() for r in got] == [{n: f"<{n}>" for n in names}]
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_run_gives_the_same_rows_again(spark):
    first, second = (corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").groupBy("doc_id", "n_tokens").count() for _ in range(2))
    assert first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()
