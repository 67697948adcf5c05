"""The named method of the pipeline's near-duplicate stage, what encoding holds at once, and texts of one line."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline as C
from riskloom.llm import similar, simhash, suffix_dedup, tokens
from test_operators import slow_removed
from test_pipeline import alike_components, prose


def test_near_duplicate_stage_finds_near_copies_by_fingerprints(spark, monkeypatch):
    def no_lists(few):
        def run(batches):
            for _ in batches:
                yield from ()

        return run

    monkeypatch.setattr(similar, "_pairs", no_lists)
    texts = []
    for k in range(8):
        words = prose(k, 1500).split()
        texts += [" ".join(words), " ".join([*words[:700], "changed", *words[701:]])]
    fps = [simhash.simhash(similar.shingles(t.encode())) for t in texts]
    near = sum((a ^ b).bit_count() <= 3 for a, b in zip(fps[::2], fps[1::2], strict=True))
    kept = C.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert near > 4 and kept.count() == len(texts) - near


def test_near_duplicate_stage_checks_what_fingerprints_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "simhash", lambda h: 0)
    texts = [None, "", *(prose(k, 30) for k in range(12))]
    texts += [f"{texts[2]} more", texts[3].replace(" ", "  "), "a b"]
    kept = C.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert kept.count() == alike_components(texts) < len(texts)


def test_simhash_of_sets_by_bits():
    h = np.array([random.Random(k).getrandbits(64) for k in range(40_001)], np.uint64)
    want = sum(1 << k for k in range(64) if 2 * int(((h >> np.uint64(k)) & np.uint64(1)).sum()) > len(h))
    assert simhash.simhash(h) == want and simhash.simhash(h[:0]) == 0 and simhash.simhash(h[:1]) == int(h[0])


def test_encoding_holds_little_besides_the_ids():
    r = random.Random(1)
    words = prose(5, 3000).split()
    texts = pa.array([" ".join(r.choices(words, k=500)) for _ in range(1000)])
    tokens.encode(texts[:2])
    tracemalloc.start()
    ids, counts = tokens.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.sum() == len(ids) and peak < 16 * len(ids)
    assert ids[counts[:-1].sum() :].tolist() == tokens.encode_one(texts[-1].as_py())


def test_contexts_that_a_text_repeats_are_one_row(spark):
    lines = b"one short line\n" * 700
    batch = pa.RecordBatch.from_pydict({"t1": [1], "t2": [2], "text": [lines]})
    rows = [r for b in suffix_dedup._contexts(iter([batch])) for r in b.to_pylist()]
    assert len(rows) < 10 and sum(r["own"] for r in rows) > 600
    texts = [lines, lines + prose(3, 90).encode(), prose(4, 90).encode() + lines[:400], lines[:414], b"xy" * 400 + prose(3, 90).encode()]
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == [(k, *w) for k, w in enumerate(slow_removed(texts))]
