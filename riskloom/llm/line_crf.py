"""Document quality from a linear-chain conditional random field over its lines.

Every line is good or bad. Its evidence is what it and the lines before and after it look like (shares of capitals,
marks, bars and digits, repeated words, word pairs and lines); a sticky transition joins neighbours. Training lines
take their document's label. A document's score is its lines' forward-backward marginals, weighted by length and
calibrated by a logistic curve on the training documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_rows, pieces, ship

SAMPLE, SAMPLE_LINES, SAMPLE_CHARS, ROUNDS, ACCEPT = 3000, 400, 200_000, 120, 0.7
OWN = 11

_KIND = np.zeros(256, np.uint8)
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_KIND[[*b"abcdefghijklmnopqrstuvwxyz"]] = 2
_KIND[128:] = 2
_KIND[[*b"0123456789"]] = 3
_KIND[[*b"#$%&*@^~<>{}[]=+\\"]] = 4
_KIND[[*b"|"]] = 5
_KIND[[*b"!?"]] = 6


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with its neighbours', its weight (bytes, 1 at least), and the number of lines by text."""
    split = [t.split(b"\n") for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    lines = [x for own in split for x in own]
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    own = np.zeros((len(lines), OWN), np.float32)
    kinds = _KIND[np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)]
    starts = np.cumsum(n + 1) - n - 1
    sums = [np.add.reduceat((kinds == k).view(np.uint8), starts, dtype=np.int32) if len(lines) else np.empty(0) for k in range(1, 7)]
    upper, lower, digit, mark, bar, bang = sums
    size = np.maximum(n, 1)
    own[:, 0] = upper / np.maximum(upper + lower, 1)
    own[:, 1] = 4 * digit / size
    own[:, 2] = 4 * mark / size
    own[:, 3] = 10 * bar / size
    own[:, 4] = 10 * bang / size
    at = 0
    for doc in split:
        seen: set[bytes] = set()
        for line in doc:
            words = line.split()
            m = len(words)
            if m > 1:
                after = words[1:]
                own[at, 5] = sum(map(eq, words, after)) / (m - 1)
                own[at, 6] = 1 - len(set(words)) / m
                own[at, 7] = 1 - len(set(zip(words, after, strict=False))) / (m - 1)
            own[at, 8] = math.log1p(m) / 5
            if m:
                own[at, 9] = min(len(line) / m, 40) / 20
                own[at, 10] = line in seen
                seen.add(line)
            at += 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first = np.cumsum(counts) - counts
    before[first], after[first[1:] - 1] = 0, 0
    edge = np.zeros((len(lines), 2), np.float32)
    edge[first, 0] = 1
    edge[first + counts - 1, 1] = 1
    return np.concatenate((own, before, after, edge, np.ones((len(lines), 1), np.float32)), axis=1), size, counts


def marginals(evidence: np.ndarray, counts: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """P(good) of each line: forward and backward messages as ratios good / bad. stay: exp of the four transitions."""
    bb, bg, gb, gg = stay.tolist()
    e = np.exp(np.clip(evidence, -30, 30)).tolist()
    out, at = [0.0] * len(e), 0
    for n in counts.tolist():
        ratio = 1.0
        for k in range(at, at + n):
            ratio = e[k] if k == at else e[k] * (ratio * gg + bg) / (ratio * gb + bb)
            out[k] = ratio
        back = 1.0
        for k in range(at + n - 1, at - 1, -1):
            odds = out[k] * back
            out[k] = odds / (1 + odds)
            x = e[k] * back
            back = (x * gg + gb) / (x * bg + bb)
        at += n
    return np.array(out)


def train(x: np.ndarray, weights: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Maximum likelihood with a small ridge, by Adam on all documents; then the calibration.

    Lines are kept once, by their place in the document and then by document, longest first: the lines of one place are
    a slice, and its documents are the first of those of the place before. No document is padded.
    """
    order = np.argsort(-counts, kind="stable")
    lengths, y, first = counts[order], labels[order].astype(np.float64), (np.cumsum(counts) - counts)[order]
    docs, longest, wide = len(counts), int(counts.max()), x.shape[1]
    live = [int((lengths > t).sum()) for t in range(longest)]
    at = np.concatenate(([0], np.cumsum(live)))
    lines = x[np.concatenate([first[:n] + t for t, n in enumerate(live)])]
    of = np.concatenate([np.arange(n) for n in live])
    share, last = (lengths**-0.5)[of], at[lengths - 1] + np.arange(docs)
    of_place = [slice(at[t], at[t + 1]) for t in range(longest)]
    theta = np.zeros(wide + 4)
    theta[wide:] = [1, 0, 0, 1]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    kept = np.zeros(4)
    for good in (0, 1):  # transitions that stay within the document's own label
        kept[3 * good] = share[at[1] :][(y[of] > 0)[at[1] :] == bool(good)].sum()
    for step in range(1, rounds + 1):
        evidence, trans = (lines @ theta[:wide].astype(np.float32)).astype(np.float64), theta[wide:].reshape(2, 2)
        forward, backward = np.zeros((len(lines), 2)), np.zeros((len(lines), 2))
        for t, here in enumerate(of_place):
            if t:
                forward[here] = np.logaddexp.reduce(forward[at[t - 1] : at[t - 1] + live[t], :, None] + trans, axis=1)
            forward[here, 1] += evidence[here]
        for t in range(longest - 2, -1, -1):
            b = backward[of_place[t + 1]].copy()
            b[:, 1] += evidence[of_place[t + 1]]
            backward[at[t] : at[t] + live[t + 1]] = np.logaddexp.reduce(trans + b[:, None, :], axis=2)
        joint = forward + backward
        good = 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -50, 50)))
        grad = np.zeros_like(theta)
        grad[:wide] = ((y[of] - good) * share).astype(np.float32) @ lines
        grad[wide:] = kept
        logz = np.logaddexp.reduce(forward[last], axis=1)
        for t in range(1, longest):
            here, n = of_place[t], live[t]
            b = backward[here].copy()
            b[:, 1] += evidence[here]
            pair = np.exp(forward[at[t - 1] : at[t - 1] + n, :, None] + trans + b[:, None, :] - logz[:n, None, None]) * share[here, None, None]
            grad[wide:] -= pair.sum(axis=0).ravel()
        grad = grad / docs - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = {"weights": theta[:wide], "stay": np.exp(theta[wide:]), "calibration": np.zeros(2)}
    mean = document_means(x, weights, counts, model)
    inputs, beta = np.stack([np.ones_like(mean), mean], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-inputs @ beta))
        hessian = (inputs * (p * (1 - p))[:, None]).T @ inputs + 0.05 * np.eye(2)
        beta += np.linalg.solve(hessian, inputs.T @ (labels - p) - 0.05 * beta)
    return model | {"calibration": beta}


def document_means(x: np.ndarray, weights: np.ndarray, counts: np.ndarray, model: dict) -> np.ndarray:
    good = marginals(x @ model["weights"], counts, model["stay"]) * weights
    first = np.cumsum(counts) - counts
    return np.add.reduceat(good, first) / np.add.reduceat(weights, first) if len(counts) else np.empty(0)


def score_texts(texts: list[bytes], model: dict) -> np.ndarray:
    x, weights, counts = line_features(texts)
    mean = document_means(x, weights, counts, model)
    return 1 / (1 + np.exp(-(model["calibration"][0] + model["calibration"][1] * mean)))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 2 on division by 4 (null id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


MODEL = ("weights", "stay", "calibration")


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the model of all the rows given; without both labels ``stay`` is empty."""
    rows = sorted((i, q, t) for b in batches for i, q, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "quality", "text")), strict=True))
    y = np.array([q for _, q, _ in rows])
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 0.5) / (len(y) + 1)
        model = {"weights": np.zeros(3 * OWN + 3), "stay": np.empty(0), "calibration": np.array([math.log(p / (1 - p)), 0.0])}
    else:
        x, weights, counts = line_features([t for _, _, t in rows])
        model = train(x, weights, counts, y)
    yield arrow_rows(pa.schema([(c, pa.list_(pa.float64())) for c in MODEL]), **{c: [model[c].tolist()] for c in MODEL})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES, sample_chars: int = SAMPLE_CHARS) -> dict:
    """A model of at most ``sample`` labelled documents, the first by a hash of their id, none of them held out.

    The sample is drawn from texts of at most ``sample_lines`` lines and under ``sample_chars`` characters; others are
    scored like all but not learnt from. Of texts with one id the first in order is taken. One task learns from the
    sample, whose bounds are its bounds too; only the model reaches the driver. Without such documents of both kinds
    the model gives every document the share of label 1 (0.5 without any) and isn't ``fitted``.
    """
    ship(docs.sparkSession)
    known = labels.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = F.length("text") - F.length(F.translate("text", "\n", ""))
    text = text.where((F.length("text") < sample_chars) & (lines < sample_lines))
    some = known.join(text.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = text.join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").cast("binary").alias("text"))
    learnt = chosen.repartition(1).mapInArrow(_learn, ", ".join(f"{c} array<double>" for c in MODEL)).collect()
    model = {c: np.array(learnt[0][c]) for c in MODEL} if learnt else {"weights": np.zeros(3 * OWN + 3), "stay": np.empty(0), "calibration": np.zeros(2)}
    return model if len(model["stay"]) else model | {"stay": np.ones(4), "fitted": False}


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.7 on) of every document.

    Scores see the text alone. Null and empty texts are one empty line. Null ids and repeated rows each return.
    Other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
            yield arrow_rows(SCORES, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), score=score_texts(texts, model))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    scored = slim.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores 0.7 or more; all of them under a model that
    isn't fitted, as it can't tell them apart."""
    if not model.get("fitted", True):
        return docs
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(score_texts(texts, model) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
