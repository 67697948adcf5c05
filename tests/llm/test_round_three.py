"""Fill in the middle, toxicity and hard negatives: brute force, round trips, held-out accuracy, odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import fill_middle, pivots, toxicity

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\t ", "a", " a", "a ", "a b", "é ü  ß\r\n", "x<P>y", "<S>", "z <M", "a<b <S c<", "\x1f\x00 \x0b\x0c", "日本 語　 字", "<" * 9, "\u0085  x "]


def slow_fill(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", text, None, None
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    spm = h[3] % 100 < 80
    return doc_id, n, "spm" if spm else "psm", f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_bits_rank_and_select_match_counting():
    for n in (0, 1, 7, 8, 511, 512, 513, 5000):
        marks = np.random.default_rng(n).random(n) < 0.3
        bits, at = fill_middle.Bits(marks), np.arange(n + 1)
        assert bits.rank(at).tolist() == np.append(0, marks.cumsum()).tolist()
        ones = np.nonzero(marks)[0]
        assert bits.select(np.arange(len(ones))).tolist() == ones.tolist()


def test_fill_in_middle_matches_brute_force_on_odd_texts(spark):
    r = random.Random(5)
    texts = ODD + ["".join(r.choice("ab é<P>SM \n\t\x0b") for _ in range(r.choice([3, 40, 700]))) for _ in range(120)]
    long = " ".join(["word"] * 1_500_000) + " é"
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "null id here"), (7, "twice a b c"), (7, "twice a b c"), (-5, "below zero x"), (10**15, "far off"), *[(k, long) for k in (900, 901, 902)]]
    docs = spark.createDataFrame([(*x, "en", 1, "f") for x in rows], "doc_id long, text string, lang string, n int, form string")
    made = fill_middle.transform(docs)
    key = lambda x: (x[0] is None, x[0] or 0, x[3])
    got = sorted((tuple(x) for x in made.collect()), key=key)
    want = sorted((slow_fill(*x) for x in rows), key=key)
    assert got == want
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    digests = fill_middle.digests(made).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(x.restored_sha256 for x in digests) == sorted(sha(t or "") for _, t in rows)
    assert sorted(x.output_sha256 for x in digests) == sorted(sha(x[3]) for x in want)
    assert fill_middle.digests(fill_middle.transform(docs.limit(0))).count() == 0


def test_fill_in_middle_of_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert sorted(tuple(x) for x in fill_middle.transform(docs).collect()) == sorted(slow_fill(x.doc_id, x.text) for x in docs.collect())


# -- 12: toxicity


def edits(a, b):
    """Edit distance with swaps of neighbours (each letter edited once), by the whole table."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)][len(b)]


def test_automaton_matches_edit_distances():
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    terms = sorted({(word(r.randint(2, 7)), r.random() < 0.3, r.randint(0, 2)) for _ in range(14)})
    terms = list({t[0]: t for t in terms}.values())
    automaton = toxicity.Automaton(terms)
    for _ in range(4000):
        w = word(r.randint(1, 9))
        found = []
        for k, (text, stem, most) in enumerate(terms):
            e = min(edits(text, w[:n]) for n in range(len(w) + 1)) if stem else edits(text, w)
            if e <= most:
                found.append((e, k))
        got = automaton.find(w)
        assert (got is None) == (not found), w
        assert not found or got[0] == min(found)[0], (w, got, found)


def test_automaton_forgets_within_its_bound(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE", 50)
    automaton = toxicity.Automaton([("idiot", False, 1)])
    assert [automaton.find(f"w{k}") for k in range(500)] == [None] * 500
    assert automaton.find("idoit") == (1, 0) and len(automaton.known) + len(automaton.steps) < 60


@pytest.mark.parametrize(
    ("text", "at", "inside"),
    [('he said "you idiot" then', "idiot", True), ("«quel idiot»", "idiot", True), ("“an idiot” he", "idiot", True), ('an idiot "quoted words"', "idiot", False), ('"first" idiot "second"', "idiot", False), ('an "idiot\nnext" line', "idiot", False), ("plain idiot", "idiot", False), ('"' + "w " * 30 + "idiot" + " w" * 30 + '"', "idiot", False)],
)
def test_quotations(text, at, inside):
    k = text.index(at)
    assert toxicity.quoted(text, k, k + len(at)) is inside


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("acdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def small_model():
    r, toxic, clean = random.Random(2), [], []
    for k in range(150):
        words = prose(k, 60).split()
        clean.append(prose(1000 + k, 60))
        for w in r.sample(["scoundrel", "zoibwrkt", f"zoibw{'rst'[k % 3]}x"], 2):
            words.insert(r.randrange(60), w)
        toxic.append(" ".join(words))
    copies = [prose(77, 50) + " rarelyseen"] * 40  # one text, many copies: its words are no terms
    return toxicity.learn(toxic + copies + clean, [1] * 190 + [0] * 150, (1500, 190))


def test_toxicity_learns_terms_and_context():
    model = small_model()
    words = {w for w, _, _ in model["terms"]}
    assert "scoundrel" in words and not any(w.startswith("rarely") for w in words)
    assert any(stem and "zoibwr".startswith(w) for w, stem, _ in model["terms"])
    automaton = toxicity.Automaton(model["terms"])
    p = lambda t: 1 / (1 + np.exp(-toxicity.features(t, automaton) @ model["weights"]))
    base = prose(5000, 40)
    assert p(base) < 0.5 < p(base + " you scoundrel") and p(base + " you scuondrel, you sc0undrel") > 0.5
    assert p(base + ' he called them "scoundrel" once') < 0.5


def test_toxicity_scores_odd_rows(spark):
    long = prose(9, 400_000)
    rows = [(1, None), (2, ""), (None, "you scoundrel"), (3, "SCOUNDREL!"), (3, "SCOUNDREL!"), (4, long + " scoundrel"), (5, long)]
    docs = spark.createDataFrame([(*x, "en", 0.5, True) for x in rows], "doc_id long, text string, lang string, score double, held_out boolean")
    got = toxicity.score(docs, small_model()).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x.predicted)
    assert by[1] == by[2] == by[5] == [0] and by[3] == [1, 1] and by[None] == by[4] == [1]
    assert toxicity.score(docs.limit(0), small_model()).count() == 0


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(x.score, 6) for x in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    clean = spark.createDataFrame([(k, 0) for k in range(9)], "doc_id long, toxic int")
    assert all(x.score < 0.5 for x in toxicity.score(docs, toxicity.fit(docs, clean)).collect())


def test_toxicity_holds_out_and_generalises(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = toxicity.fit(docs, labels)
    assert toxicity.fit(docs, known)["terms"] == model["terms"]
    scored = toxicity.score(docs, model).join(labels, "doc_id").where("held_out")
    right = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert right[0] > 0.98 and right[1] > 0.88 and right[2] < 0.01


# -- 13: hard negatives


def slow_negatives(rows):
    fine = [(i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * float(x))) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, label, v in {(i, y, tuple(v)) for i, y, v in fine if i % 100 == 0}:
        scored = sorted(((-sum(p * q for p, q in zip(v, w, strict=True)), i, y) for i, y, w in fine if len(w) == len(v)))
        for s, p, _ in [x for x in scored if x[2] == label and x[1] != a][:5]:
            met = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(met)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*x, "q", 1.0) for x in rows], "vec_id long, embedding array<double>, label int, anchor string, score double")


@pytest.mark.parametrize("shard", [8192, 150])
def test_hard_negatives_match_brute_force(spark, shard):
    r = np.random.default_rng(4)
    rows = [(k, r.normal(size=12).round(3).tolist(), int(r.integers(0, 10))) for k in range(700)]
    rows += [(k, [0.5] * 12, k % 3) for k in range(1000, 1300)]  # one very common vector, ties by id
    rows += [(2000, None, 1), (2100, [0.1] * 12, None), (2200, [float("nan")] * 12, 1), (2300, [None] * 12, 1), (2400, [float("inf")] * 12, 2), (None, [0.2] * 12, 1), (2500, [0.0] * 12, 3), (2600, [], 4), (2601, [], 4), (2700, [1.0, 2.0], 5), (2701, [1.0, 3.0], 5), (2702, [2.0, 2.0], 6), (-100, [0.3] * 12, 2)]
    got = sorted(tuple(x) for x in pivots.hard_negatives(vectors(spark, rows), shard=shard).collect())
    assert got == slow_negatives(rows) and len(got) > 100


def test_hard_negatives_of_long_vectors_stay_exact(spark):
    r = np.random.default_rng(6)
    rows = [(k, (r.normal(size=4) * 4e5).tolist(), k % 4) for k in range(1, 300)] + [(300, [4e5] * 4, 1), (301, [1e300] * 4, 1)]
    got = sorted(tuple(x) for x in pivots.hard_negatives(vectors(spark, rows)).collect())
    assert got == slow_negatives([x for x in rows if x[0] != 301]) and got


def test_hard_negatives_of_repeated_rows_and_none(spark):
    r = np.random.default_rng(8)
    rows = [(k, np.abs(r.normal(size=5)).tolist(), k % 2) for k in range(40)]
    once = pivots.hard_negatives(vectors(spark, [*rows, rows[0], rows[0]]))
    assert sorted(tuple(x) for x in once.collect()) == slow_negatives([*rows, rows[0], rows[0]])
    assert pivots.hard_negatives(vectors(spark, rows).limit(0)).count() == 0


def test_pivot_brackets_leave_rows_out(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16)) * 2
    x = np.floor(256 * (centres[np.arange(4000) % 12] + r.normal(size=(4000, 16)) * 0.05))
    label = np.arange(4000) % 10
    rows = pa.table({"vec_id": np.arange(4000), "label": label, "vector": pa.array(x.tolist(), pa.list_(pa.float64()))})
    some = pa.table({"anchor": np.arange(8), "vec_id": np.arange(8), "label": label[:8], "vector": pa.array(x[:8].tolist(), pa.list_(pa.float64()))})
    (index,), (asked,) = pivots.build(rows).values(), pivots.prepare(some).values()
    ids, scores, work = pivots.find(index, asked, 5)
    assert work["exact"] < 0.5 * work["pairs"]
    for k in range(8):
        want = sorted(((-int(x[k] @ x[i]), i) for i in range(4000) if label[i] == label[k] and i != k))[:5]
        assert list(zip((-scores[k]).tolist(), ids[k].tolist(), strict=True)) == want
