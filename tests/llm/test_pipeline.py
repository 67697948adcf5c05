"""The pipeline's stages on small fixtures: each decision takes effect and clean documents stay."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from riskloom.llm import similar
from riskloom.llm.common import stage


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, apply in C.STAGES[:-1]:
        docs = stage(apply(spark, docs, tiny), f"test-{name}")
        assert docs.columns == columns
    assert before > 0
    packed = C.STAGES[-1][1](spark, docs, tiny)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_duplicate_stage_keeps_one_of_each(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = C.near_duplicates(spark, docs, tiny)
    assert kept.count() == alike_components([r.text for r in docs.select("text").collect()])
    assert kept.exceptAll(docs).count() == 0


def test_quality_stage_keeps_rows_as_they_are(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = C.quality(spark, docs, tiny)
    assert 0 < kept.count() < docs.count() and kept.exceptAll(docs).count() == 0
    good = spark.read.parquet(f"{tiny}/labels.parquet").where("quality = 1").join(docs, "doc_id", "left_semi")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count() + 1


def test_odd_rows_pass_all_stages(spark, tiny):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, prose(1, 60), "en", None, 1), (3, prose(2, 60), "en", "a", 1), (3, prose(2, 60), "en", "a", 1), (4, prose(3, 900), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("mix_size", F.lit(1))
    for _, apply in C.STAGES[:-1]:
        docs = stage(apply(spark, docs, tiny), "odd")
    assert C.STAGES[-1][1](spark, docs, tiny).count() > 0
    empty = docs.limit(0)
    for _, apply in C.STAGES:
        empty = apply(spark, empty, tiny)
    assert empty.count() == 0


def alike_components(texts):
    """Components of all pairs of distinct texts whose five-word shingles are alike by 0.8 or more, by brute force."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    sets = sorted(set(sets), key=len)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j, y in enumerate(sets):
        for i in range(j - 1, -1, -1):
            if 5 * len(sets[i]) < 4 * len(y):
                break
            if 9 * len(sets[i] & y) >= 4 * (len(sets[i]) + len(y)):
                parent[find(j)] = find(i)
    return len({find(k) for k in range(len(sets))})


@pytest.mark.parametrize(("few", "sample"), [(64, 16384), (2, 1)])
def test_near_duplicate_stage_links_all_pairs_of_four_fifths(spark, monkeypatch, few, sample):
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "SAMPLE", sample)
    r, texts = random.Random(3), []
    for k in range(40):
        words = prose(k, r.choice([9, 30, 200])).split()
        texts.append(" ".join(words))
        for _ in range(r.choice([0, 1, 6])):
            new = list(words)
            for at in r.sample(range(len(words)), r.choice([1, 1, 2, max(1, len(words) // 50)])):
                new[at] = "changed"
            texts.append(" ".join(new))
    passage = prose(99, 60)
    texts += [f"{passage} {prose(500 + k, 40)}" for k in range(80)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = C.near_duplicates(spark, docs, "")
    assert kept.count() == alike_components(texts) < len(texts)
    assert kept.exceptAll(docs).count() == 0


def test_near_duplicate_stage_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert C.near_duplicates(spark, docs, "").count() == alike_components([r.text for r in docs.select("text").collect()])
