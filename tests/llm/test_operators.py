"""The ten operators on small fixtures: brute force, exact round trips, and odd rows (nulls, empties, repeats, clashes)."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import (
    hamming,
    html_text,
    line_crf,
    mixing,
    packing,
    pii,
    queries,
    simhash,
    suffix_array,
    suffix_dedup,
    token_counts,
    tokens,
    vptree,
)
from riskloom.llm.graph import components

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp string, spans string, passes int, size int"


def frame(spark, rows):
    """Rows of (doc_id, text, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 9, 7) for i, t, s in rows], DDL)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


ODD = [(1, None, "a"), (2, "", "a"), (3, "   \n ", None), (None, "one two three four", "b"), (4, "one two three four", None), (4, "one two three four", None), (5, "word", "b"), (6, "A B <|endoftext|>  x", "c"), (7, prose(1, 3000), "a")]


# -- 1: near duplicates


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 3:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def test_near_duplicates_match_brute_force(spark):
    base = prose(3, 400).split()
    near = []
    for k in range(60):
        words = list(base)
        words[k * 6] = f"edit{k}"
        near.append(" ".join(words))
    rows = [*ODD, *[(100 + k, t, "a") for k, t in enumerate([*near, *near[:5], *[prose(50 + k, 30) for k in range(20)]])]]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    roots = slow_components(fps)
    least = {r: min((i for (i, _, _), x in zip(rows, roots) if x == r and i is not None), default=None) for r in set(roots)}
    want = Counter((i, f"{f:016x}", least[r]) for (i, _, _), f, r in zip(rows, fps, roots))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def clustered(n, seed=5):
    r = np.random.default_rng(seed)
    centers = r.integers(0, 2**63, 6, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(20, r.integers(0, 5), replace=False)) for _ in range(n)], np.uint64)
    return np.unique(centers[r.integers(0, 6, n)] ^ flips)


@pytest.mark.parametrize("limit", [4096, 8])
def test_long_lists_keep_every_connection(limit, monkeypatch):
    monkeypatch.setattr(simhash, "LIST", limit)
    fps = clustered(300)
    import pyarrow as pa

    def batches(rows):
        rows.sort()
        for k in range(0, len(rows), 37):
            part = rows[k : k + 37]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64())], names=["k", "v", "fp"])

    signed = fps.view(np.int64)
    rows = [(k, int(f & np.int64(m)), int(f)) for k, m in enumerate(simhash.MASKS) for f in signed]
    out = [r for b in simhash._search(False)(batches(rows)) for r in zip(*[b.column(c).to_pylist() for c in ("a", "b", "fine")])]
    fine = [(f, b, a) for a, b, f in out if f >= 0]
    assert bool(fine) == (limit == 8)
    out += [r for b in simhash._search(True)(batches(fine)) for r in zip(*[b.column(c).to_pylist() for c in ("a", "b", "fine")])] if fine else []
    names = {int(f): k for k, f in enumerate(signed)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, f in out:
        if f < 0:
            x, y = find(names[a]), find(names[b])
            parent[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(fps))] == slow_components([int(f) for f in fps])


def test_cube_forest_connects_like_forest():
    r = np.random.default_rng(2)
    low = np.unique(r.integers(0, 1 << 14, 400)).astype(np.uint64)
    a, b = simhash.cube_forest(low, (0, 1, 2))
    c, d = simhash.forest(low)
    assert len(a) == len(c)
    pairs = lambda x, y: {(int(i), int(j)) for i, j in zip(x, y)}
    assert len(pairs(a, b)) == len(pairs(c, d))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 10), (5, 5), (2, 1), (None, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_keeps_one_row_of_a_component(spark):
    rows = [*ODD, (20, ODD[-1][1], "z")]
    kept = simhash.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    assert kept.count() == len(set(slow_components(fps)))
    assert {r.doc_id for r in kept.where("text like 'one two%'").collect()} == {4}


# -- 2: mixing


def test_targets_share_what_is_over_by_weight(spark):
    rows = [(f"s{k}", n) for k, n in enumerate([10, 1000, 200, 5, 3000])] + [(None, 50)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    order = sorted([s for s, _ in rows if s is not None]) + [None]
    size, weight = dict(rows), {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, want = 1.5 * sum(size.values()), set(order), {}
    while True:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * size[s]
            left -= want[s]
            open_.remove(s)
    want |= {s: share * weight[s] for s in open_}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_apportion_is_sainte_lague(spark):
    claims = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.4, "e": 0.0}
    for seats in (0, 1, 2, 7, 10, 100):
        df = spark.createDataFrame([(1, k, v, seats, 10**6) for k, v in claims.items()], "g int, name string, claim double, seats long, most long")
        got = {r.name: r.quota for r in mixing.apportion(df, ["g"], "seats", "claim", ["name"], "most").collect()}
        won = Counter()
        for _ in range(seats):
            won[max(sorted(claims), key=lambda k: claims[k] / (2 * won[k] + 1))] += 1
        assert got == {k: won[k] for k in claims}, seats


def test_mix_meets_targets_and_reruns(spark):
    rows = ODD + [(100 + k, prose(k, 40 + k % 90), f"s{k % 5}") for k in range(600)]
    df = frame(spark, rows)
    got = mixing.mix(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows) and Counter(got) == Counter(mixing.mix(df.repartition(3)).select("doc_id", "source", "size", "source_size", "target", "taken").collect())
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(2 * mixing.BLOCK, 0.01 * mine[0].target)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = mixed.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == sum(r.taken for r in got)


# -- 3 and 6: searches


def slow_nearest(rows, k, every):
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    out = {}
    for q, v in rows:
        if q % every == 0:
            d = np.sqrt(((x - np.array(v, float)) ** 2).sum(axis=1))
            out[q] = sorted((float(y), i) for y, i in zip(d, ids) if i != q)[:k]
    return out


@pytest.mark.parametrize("relax", [1.0, vptree.RELAX])
def test_nearest(spark, relax):
    r = np.random.default_rng(1)
    centers = r.normal(size=(8, 16))
    rows = [(k, (centers[k % 8] + 0.3 * r.normal(size=16)).astype(np.float32).tolist()) for k in range(900)] + [(1000 + k, [1.0] * 16) for k in range(40)]
    odd = [(1500, None), (1600, [0.0] * 16), (1700, [float("nan")] * 16), (1800, [None] * 16), (None, [1.0] * 16), (1900, [1.0] * 3), (2000, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("shard", F.lit(3))
    got = {}
    for row in vptree.nearest(df, df.where("vec_id % 100 = 0"), relax=relax, shard=300).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    want = slow_nearest(rows, 10, 100)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11))
        hits += len({x[1] for x in found} & {i for _, i in want[q]})
        if relax == 1.0:
            assert [x[1] for x in found] == [i for _, i in want[q]]
            assert np.allclose([x[2] for x in found], [d for d, _ in want[q]], rtol=1e-12)
    assert hits / (10 * len(want)) >= 0.9


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in vptree.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1)]
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_hamming_matches_brute_force(spark):
    r = np.random.default_rng(4)
    codes = [int(x) for x in clustered(400).view(np.int64)] + [int(x) for x in r.integers(-(2**62), 2**62, 200)]
    rows = [(k, c) for k, c in enumerate(codes)] + [(5000 + k, codes[0]) for k in range(60)]
    df = spark.createDataFrame(rows + [(None, 3), (7000, None), (50, codes[50])], "vec_id long, code long")
    got = {}
    for row in hamming.nearest_codes(df, df.where("vec_id % 50 = 0").distinct(), shard=200).collect():
        got.setdefault(row.query_id, []).append((row.distance, row.vec_id))
    every = rows + [(50, codes[50])]
    for q, c in dict(rows).items():
        if q % 50 == 0:
            want = sorted((bin((c ^ x) & (2**64 - 1)).count("1"), i) for i, x in every if i != q)[:10]
            assert sorted(got[q]) == want
    few = spark.createDataFrame([(0, 1), (1, -1)], "vec_id long, code long")
    assert [(r.vec_id, r.distance) for r in hamming.nearest_codes(few, few.where("vec_id = 0")).collect()] == [(1, 63)]


# -- 4: personal data


def test_surrogates(spark):
    rows = [
        (1, "Call +1 (743) 555-3824 or 743-555-3824, mail Hein.19@Mail5.example.com / hein.19@mail5.example.com from 152.143.123.131.", "a"),
        (2, "Mr. John Smith met Mrs Doe and Господин Иванов; 4111 1111 1111 1111 is 4111111111111111", "a"),
        (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" 078-05-1120', "a"),
        (4, "Licensed under the Apache License, Version 2.0. On 2024-01-02 some 12 345 items. WITHTHNDBLEING", "a"),
        *ODD,
    ]
    df = frame(spark, rows).withColumn("n_entities", F.lit("mine"))
    got = {(r.doc_id, r.source): r for r in pii.replace(df).collect()}
    one = got[1, "a"].text if got[1, "a"].text else next(r.text for r in pii.replace(df).where("doc_id = 1 and text is not null").collect())
    for secret in ("555-3824", "ein.19@", "152.143", "Smith", "Doe", "Иванов", "4111 1111 1111", "24be6443", "9233A8EC", "05-1120"):
        assert not any(secret in (r.text or "") for r in got.values())
    import re

    digits = re.findall(r"\d{3}[) -]+\d{3}-\d{4}", one)
    assert len({re.sub(r"\D", "", x) for x in digits}) == 1 and "+1 (" in one
    mails = re.findall(r"\S+@\S+\.com", one)
    assert mails[0].lower() == mails[1] and mails[0] != mails[1]
    two = next(r.text for r in pii.replace(df).where("text like 'Mr.%'").collect())
    cards = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", two)
    assert cards[0].replace(" ", "") == cards[1]
    assert sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(cards[1]))) % 10 == 0
    assert re.search("Господин [А-Я]", two) and re.search("Mr. [A-Z][a-z]+ [A-Z]", two)
    before, after = Counter((i, t) for i, t, _ in rows if t is None or len(t) > 200 or "Apache" in t), Counter((r.doc_id, r.text) for r in pii.replace(df).collect())
    assert all(after[k] >= n for k, n in before.items() if k[1] is None or "Apache" in k[1])


@pytest.mark.parametrize("few", [500, 2])
def test_collisions_get_new_surrogates(spark, monkeypatch, few):
    monkeypatch.setattr(pii, "LITERALS", few)
    names = [f"Mr {chr(65 + k // 26)}{chr(97 + k % 26)}lderson" for k in range(200)]
    df = frame(spark, [(k, f"so {n} said to {n}", "a") for k, n in enumerate(names)])
    out = [r.text for r in pii.replace(df).collect()]
    made = [t.removeprefix("so ").split(" said to ") for t in out]
    assert all(a == b for a, b in made)
    assert len({a for a, _ in made}) == len(names) and not {a for a, _ in made} & set(names)


def test_names_never_run_out(spark, monkeypatch):
    monkeypatch.setattr(pii, "NAMES", {k: v[:1] for k, v in pii.NAMES.items()})
    monkeypatch.setattr(pii, "SURNAMES", {k: v[:1] for k, v in pii.SURNAMES.items()})
    # one surname and three hex characters make 4097 names
    syllables = ["ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "wo", "xu", "za", "bo"]
    names = [f"Mr {a.title()}{b}{c}" for a, b, c in itertools.product(syllables, repeat=3)]
    names += [f"Господин {a.title()}{b}" for a, b in itertools.product(["ба", "де", "фи", "го", "ку", "ла"], repeat=2)]
    out = [r.text for r in pii.replace(frame(spark, [(k, n, "a") for k, n in enumerate(names)])).collect()]
    assert len(names) > 4097 and len(set(out)) == len(names) and not set(out) & set(names)
    russian = [t.removeprefix("Господин ") for t in out if t.startswith("Господин")]
    assert len(russian) == 36 and not any(c.isascii() and c.isalpha() for t in russian for c in t)


PHONES = [
    *("+7 (495) 123-45-67", "8 (495) 123-45-67", "+49 (30) 1234567", "+49 (0)30 123456", "+44 (0)20 7946 0958", "+33 1 23 45 67 89", "01 23 45 67 89"),
    *("030 12345678", "5551234567", "(030) 12345678", "030/1234567", "+74951234567", "84951234567", "8 (5) 234 5678", "+1 (743) 555-3824", "743-555-3824"),
]
NO_PHONES = ["01.02.2024", "05/06/2023 at 10", "0.1234567", "10 000 000 000", "2024-01-02 03:04:05", "8 16 32 64 128", "1700000000", "3.14159265358", "8 123 456"]


def test_phone_formats(spark):
    rows = [(k, f"call {p}, then wait", "a") for k, p in enumerate(PHONES)] + [(100 + k, f"on {x} it was", "a") for k, x in enumerate(NO_PHONES)]
    got = {r.doc_id: r for r in pii.replace(frame(spark, rows)).collect()}
    shape = lambda t: "".join("9" if c.isdigit() else c for c in t)
    for k, text, _ in rows:
        assert got[k].entity_types == (["phone"] if k < 100 else []), text
        assert (got[k].text != text) == (k < 100) and shape(got[k].text) == shape(text), text
    kept = {"+7 (495) 123-45-67": "+7 (", "8 (495) 123-45-67": "8 (", "+49 (0)30 123456": "+49 (0)", "+33 1 23 45 67 89": "+33 ", "01 23 45 67 89": "0", "+74951234567": "+7"}
    made = {p: got[k].text[5:-11] for k, p in enumerate(PHONES)}
    assert all(made[p].startswith(x) for p, x in kept.items())
    last = lambda p, n: "".join(c for c in made[p] if c.isdigit())[-n:]
    assert last("+7 (495) 123-45-67", 10) == last("8 (495) 123-45-67", 10) == last("+74951234567", 10) == last("84951234567", 10)
    assert last("+33 1 23 45 67 89", 9) == last("01 23 45 67 89", 9) and last("+1 (743) 555-3824", 10) == last("743-555-3824", 10)


# -- 5: quality


def test_quality_learns_and_keeps_out(spark, tiny):
    small = tiny.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = line_crf.fit(docs, labels)
    got = line_crf.score(docs, model).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    odd = line_crf.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd)
    assert line_crf.accepted(frame(spark, ODD), model).columns == frame(spark, ODD).columns
    nothing = line_crf.fit(docs, labels.limit(0))
    assert {r.score for r in line_crf.score(frame(spark, ODD), nothing).collect()} == {0.5}


def test_quality_samples_what_it_can_learn_from(spark):
    # ten long documents come first by the hash of their id
    ids = [r.id for r in spark.range(400).where(~line_crf.held_out("id")).orderBy(F.xxhash64("id"), "id").limit(40).collect()]
    rows = [(i, "x\n" * 50 if k < 10 else prose(k, 60) if k % 2 else "$$ || 99 " * 20, "a") for k, i in enumerate(ids)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    model = line_crf.fit(docs, labels, sample=10, sample_lines=20)
    assert model.get("fitted", True) and len(set(model["weights"].tolist())) > 1
    assert not line_crf.fit(docs, labels, sample_chars=5).get("fitted", True)
    twice = frame(spark, [(i, t + "more\n", s) for i, t, s in rows] + rows)
    one, other = (line_crf.fit(d, labels, sample=20, sample_lines=20) for d in (twice, twice.orderBy(F.desc("text"))))
    assert all(np.array_equal(one[c], other[c]) for c in line_crf.MODEL)
    for few in (labels.limit(0), labels.where("quality = 0")):
        assert line_crf.accepted(docs, line_crf.fit(docs, few)).count() == len(rows)


def test_marginals_match_enumeration():
    r = np.random.default_rng(0)
    e, stay = r.normal(size=5), np.exp(r.normal(size=4))
    weight = lambda y: np.exp(sum(e[k] * y[k] for k in range(5))) * np.prod([stay[2 * y[k - 1] + y[k]] for k in range(1, 5)])
    every = list(itertools.product((0, 1), repeat=5))
    z = sum(map(weight, every))
    want = [sum(weight(y) for y in every if y[k]) / z for k in range(5)]
    assert np.allclose(line_crf.marginals(e, np.array([5]), stay), want)


# -- 7: packing


def test_packing_round_trip(spark):
    rows = ODD + [(200 + k, prose(k, 7 * k + 1), "a") for k in range(40)]
    got = packing.pack(frame(spark, rows), shard_tokens=20_000).collect()
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(tokens.whole().encode(t or "", add_special_tokens=False).ids + [1])
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for i, parts in by_doc.items():
        ids = texts[i][0]
        spans = sorted((p.start, p.length) for p in parts)
        assert sum(n for _, n in spans) == sum(map(len, texts[i]))
        for p in parts:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        if len(texts[i]) == 1:
            assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()]
    for parts in by_seq.values():
        parts.sort(key=lambda p: p.offset)
        total = sum(p.length for p in parts)
        assert [p.offset for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1].tolist()]
        assert total <= 2048 and (total == 2048 or total & (total - 1) == 0)
    assert packing.pack(frame(spark, rows).limit(0)).count() == 0


def test_packing_keeps_documents_that_fit_in_one_sequence(spark, tiny):
    got = packing.pack(spark.read.parquet(f"{tiny}/documents.parquet")).collect()
    fit = Counter(r.doc_id for r in got if r.doc_tokens <= 2048)
    assert fit and sum(n == 1 for n in fit.values()) >= 0.9 * len(fit)
    totals = Counter()
    for r in got:
        totals[r.sequence_id] += r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in totals.values())


@pytest.mark.parametrize("seed", range(40))
def test_packing_fills_any_shard(seed):
    draw = random.Random(seed)
    most = draw.choice([3, 60, 700, 1400, 2048])
    whole = [draw.random() < (seed % 4) / 4 for _ in range(draw.choice([0, 1, 5, 200]))]
    lengths = [2048 if w else draw.randint(1, most) for w in whole]
    parts = {}
    for sequence in packing.fill(lengths, whole):
        n = sum(b - a for _, a, b in sequence)
        assert n == 2048 or 0 < n < 2048 and n & (n - 1) == 0
        for i, a, b in sequence:
            parts.setdefault(i, []).append((a, b))
    assert parts.keys() == set(range(len(lengths)))
    for i, own in parts.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == lengths[i] and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))


def test_packing_classes_hold_a_fixed_count():
    lengths = [1500, 1024, 1000, 600, 590, 580] + [2048] * 3
    sequences = packing.fill(lengths, [False] * 6 + [True] * 3)
    together = sorted(sorted(i for i, _, _ in s if i < 6) for s in sequences if any(i < 6 for i, _, _ in s))
    assert together == [[0], [1, 2], [3, 4, 5]]


def test_packing_deals_equal_rows_apart(spark):
    got = packing.pack(frame(spark, [(None, None, "a")] * 5000), shard_tokens=500).collect()
    sizes = Counter(r.sequence_id >> 32 for r in got)
    assert len(got) == 5000 and max(sizes.values()) < 700


def test_tokens_match_the_tokenizer():
    import pyarrow as pa

    texts = [None, "", " ", "a  b", "a   b ", " x", "x ", "it's a\n\n b\tc", "A  B C", "x<|endoftext|>y", "ünï cödé 日本語 🙂 ok", prose(9, 500), "1 2  3 44 555", "\n \n a"]
    ids, counts = tokens.encode(pa.array(texts, pa.string()))
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == tokens.whole().encode(t or "", add_special_tokens=False).ids, t
        at += n


# -- 8: repeated passages


def slow_removed(texts):
    seen = Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        runs = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def repeated_rows():
    passage, rows = prose(11, 120), [*ODD, (8, "a" * 1300, "a"), (9, "ab" * 600, "a"), (10, "b" * 399, "a"), (11, "b" * 400, "a"), (12, "é" * 450, "a")]
    for k in range(40):
        rows.append((300 + k, prose(400 + k, 60) + " " + passage[k : len(passage) - 2 * k] + prose(500 + k, 30) + (passage[:450] if k % 7 == 0 else ""), "a"))
    return rows + [rows[-1], (900, rows[-2][1], "a")]


@pytest.mark.parametrize(("hot", "heavy"), [(1024, 4096), (2, 4096), (2, 3)])
def test_repeats_match_brute_force(spark, monkeypatch, hot, heavy):
    """Also where keys get second keys, more of them than are broadcast."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    second_keys, called = suffix_dedup._of_hot_keys, []
    monkeypatch.setattr(suffix_dedup, "_of_hot_keys", lambda cut: called.append(cut) or second_keys(cut))
    rows = repeated_rows()
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    want = slow_removed([(t or "").encode() for _, t, _ in rows])
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((i, *w) for (i, _, _), w in zip(rows, want))
    assert bool(called) == (hot == 2)
    assert suffix_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_keys_with_many_contexts_are_counted_by_window(spark, monkeypatch):
    import pyarrow as pa

    texts = [(prose(600 + k, 40) + prose(11, 120) + prose(700 + k, 40)).encode() for k in range(12)]
    rows = []
    for k, t in enumerate(texts):
        for first, last, anchor in zip(*map(np.ndarray.tolist, suffix_dedup.anchors([t])[0])):
            rows.append((xxhash.xxh3_64_intdigest(t[anchor : anchor + suffix_dedup.KEY]) >> 1, k * 1000 + first, 1, k, 0, first, last, anchor, t[first : last + 400]))
    rows.sort(key=lambda r: r[:2])
    counts = Counter(r[0] for r in rows)
    rows = [r for r in rows if counts[r[0]] > 1]
    batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), suffix_dedup.TEXTS)], schema=suffix_dedup.TEXTS)

    def covered(limit):
        monkeypatch.setattr(suffix_dedup, "GROUP", limit)
        out, seen = set(), {}
        for b in suffix_dedup._shards(iter([batch])):
            for r in b.to_pylist():
                if r["h1"] is None:
                    out |= {(r["t1"], p) for p in range(r["start"], r["end"] - 399)}
                else:
                    seen.setdefault((r["h1"], r["h2"]), []).append((r["t1"], r["start"]))
        return out | {x for own in seen.values() if len(own) > 1 for x in own}

    assert covered(8 << 20) == covered(1000) != set()


def test_suffix_arrays_and_prefixes(monkeypatch):
    r = random.Random(1)
    for _ in range(150):
        n, k = r.randint(0, 50), r.choice([1, 2, 3, 8])
        t = [r.randint(1, k) for _ in range(n)] + [0]
        for narrow in (600, 0):
            monkeypatch.setattr(suffix_array, "NARROW", narrow)
            assert suffix_array.suffix_array(np.array(t), k + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


# -- 9: token counts


def test_edits_count_like_the_whole_text():
    r = random.Random(3)
    for text in ["", "a", "  ", "a  b   c", prose(1, 400), "x\n\n y " * 200]:
        doc, now = token_counts.Document(text), text
        for _ in range(40):
            s, d, new = r.randint(-1, len(now) + 3), r.choice([0, 0, 1, 5, 300]), r.choice(["", " ", "  ", "\n", " x", "word", "a b c" * 80, "\n\n ", "'s"])
            doc.edit(s, d, new)
            s = min(max(s, 0), len(now))
            now = now[:s] + new + now[s + d :]
            assert doc.text() == now and doc.tokens.total == token_counts.count(now) == sum(doc.counts)


def test_edits_touch_little(spark):
    rows = ODD + [(50, prose(4, 4000), "a")]
    state = token_counts.build(frame(spark, rows))
    edits = spark.createDataFrame([(50, 1, 9000, 5, "new words"), (50, 0, 100, 0, "x"), (1, 0, 5, 9, "from nothing"), (4, 0, None, None, None)], "doc_id long, seq int, start int, drop int, insert string")
    got = {r.doc_id: r for r in token_counts.apply(token_counts.with_edits(state, edits)).collect()}
    want = prose(4, 4000)
    want = want[:100] + "x" + want[100:]
    want = want[:9000] + "new words" + want[9005:]
    assert got[50].text == want and got[50].n_tokens == token_counts.count(want) and got[50].n_encoded < 3000
    assert got[1].text == "from nothing" and len(got) == len({i for i, _, _ in rows})


# -- 10: HTML

PAGES = [
    (None, ""),
    ("", ""),
    ("just text", "just text"),
    ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table>", "Name       Qty\nApple pie  3"),
    ("<table><tr><td colspan=2>wide cell here<tr><td>a<td>b</table>", "wide cell here\na  b"),
    ("<div hidden>no</div><style>.x{display:none}</style><p class='x y'>no</p><i style='display: none'>no</i>a <b>b</b>", "a b"),
    ("<script>var a='</p>'</script>x &amp; y &lt;z<!-- c --><title>t</title>", "x & y <z"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("<p>unclosed <b>bold<p>next</b> 1 < 2", "unclosed bold\n\nnext 1 < 2"),
    ("<dl><dt>t<dd>d</dl><blockquote>q</blockquote>", "t\n  d\n\n  q"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_rendering(page, text):
    assert html_text.render(page) == text


SHOWN = [
    ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> b", "a x=2 b"),
    ("<svg><title>no</title><defs><text>no</text></defs>no<g><text>one</text><text>two <tspan>more</tspan></text></g></svg>after", "one\ntwo more\nafter"),
    ("<svg viewBox='0 0 1 1'><defs/><title/><path d='M0'/><text>t</text></svg>after", "t\nafter"),
    ("<svg><path/></svg>x<svg/>y", "xy"),
    ("<textarea>\na &lt; <b>\n  c</textarea>d", "a < <b>\n  c\nd"),
    ("<object data=x.swf><param name=a>fallback</object> e", "fallback e"),
    ("<dialog>no</dialog><dialog open>yes</dialog>f", "yes\nf"),
    ("<i>" * 300 + "<b hidden>no</b><u style='display:none'>no<i>no</i></u>yes" + "</i>" * 300 + "<p>z", "yes\n\nz"),
    ("<div>o<table><tr><td>" + "<b>" * 300 + "<div>k</div>l<p>m<p hidden>no<p>n" + "</b>" * 300 + "<td>q</table></div>", "o\n\nk  q\nl\nm\nn"),
    ("<div hidden>" * 300 + "no" + "</div>" * 300 + "yes", "yes"),
]


@pytest.mark.parametrize(("page", "text"), SHOWN)
def test_what_browsers_show_comes_out(page, text):
    assert html_text.render(page) == text


STRAY_ROWS = [
    ("<tr><td>text</td></tr>", "text"),
    ("<tr><td>a<td>b<tr><th>c</tr>", "a\nb\nc"),
    ("<table><tr><td>a</table></table><tr><td>lost</td></tr>", "a\n\nlost"),
    ("<div><tr>bare<td>cell</tr></div>", "bare\ncell"),
    ("<table><tr>bare<td>cell</table>", "cell  bare"),
]


@pytest.mark.parametrize(("page", "text"), STRAY_ROWS)
def test_rows_outside_tables_keep_their_text(page, text):
    assert html_text.render(page) == text


STYLES = [
    ("@media print{.n{display:none}}", True),
    ("@media (max-width:600px){.n{display:none}}", True),
    ("@media screen and (min-width: 40em){.n{display:none}}", False),
    ("@media not print{.n{display:none}} a{color:red}", False),
    ("@media print{.x{color:red}} .n{display:none}", False),
    ("@media print, (width >= 600px){.n{display:none}}", False),
    ("@keyframes k{p{visibility:hidden}} @supports (display:grid){@media print{.n{display:none}}}", True),
    (".n{display:none} /* .n{} */ .n{display:block}", True),
    (".n{display:block} .n{display:none}", False),
    (".n{display:none !important} .n{display:block}", False),
    ("#i{display:block} .n{display:none}", True),
    ("@import url(a.css); .n{display:none}", False),
]


@pytest.mark.parametrize(("sheet", "seen"), STYLES)
def test_style_sheets(sheet, seen):
    page = "<p id=i class=n>text</p>"
    assert html_text.render(f"<style>{sheet}</style>{page}") == ("text" if seen else "")
    assert html_text.render(f"<style>{sheet}</style>{page}<style>.n{{display:block!important}}</style>") == "text"
    assert html_text.render(f"<style media=print>.n{{display:none}}</style>{page}") == "text"


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(k, p) for k, (p, _) in enumerate(PAGES)] + [(None, "a"), (3, "a"), (99, deep), (98, "</p></table><td>c</td>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1))).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.page_id == 99} == {"x"}
    assert {r.text for r in got if r.page_id == 98} == {"c"}


# -- queries


def test_queries_give_the_contract_columns(spark, tiny):
    want = {
        "op1": {"doc_id", "fingerprint", "component_id"},
        "op2": {"doc_id", "size", "source_size", "target", "taken"},
        "op3": {"query_id", "rank", "vec_id", "score"},
        "op5": {"doc_id", "held_out", "score", "predicted"},
        "op7": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
        "op8": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    }
    for name, run in queries.QUERIES.items():
        df = run(spark, tiny)
        assert want.get(name.split("_")[0], set()) <= set(df.columns)
        assert df.count() > 0


def test_hamming_oracle(spark, tiny):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tiny}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL["op6_hamming_top_k"]).fetchall()
    got = queries.QUERIES["op6_hamming_top_k"](spark, tiny).collect()
    assert Counter(map(tuple, got)) == Counter(want)
