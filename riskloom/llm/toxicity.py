"""Toxicity: words within a few edits of a lexicon's terms, weighed by the context they stand in.

The lexicon is learnt from labelled texts: words and word beginnings that stand in toxic ones alone, and there among
ever other neighbours, so that copies of one text teach nothing. Its terms make a trie. Each term has a Levenshtein
automaton of its own number of edits (as many as clean training texts hardly ever meet); the intersection of trie and
automata is run as one deterministic automaton whose states are made when first met. A hit inside quotation marks, a
hit of a misspelled term and a hit with others near it weigh differently; a logistic curve over these sums is the score.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_rows, pieces, ship

#: Bounds of what is learnt from: texts of each label, and their characters.
SAMPLE, SAMPLE_CHARS = 2000, 20_000
#: Terms at most; the shortest; the evidence a term needs (log of one over the chance that it fell to toxic texts alone).
TERMS, SHORTEST, EVIDENCE = 2000, 4, 12.0
#: Share of toxic texts' rate at which a term may stand in clean ones; share of clean texts that its misspellings may meet.
CLEAN, LOOSE = 0.02, 0.002
#: Words each side of a hit that are its context; cached words and states of a worker at most.
CONTEXT, CACHE = 8, 400_000
ACCEPT = 0.5

WORD = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")
#: Marks that open a quotation, and those that end it.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’", "‹": "›", "「": "」"}


def most_edits(term: str) -> int:
    """Edits that may ever be allowed to a term of this length."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Automaton:
    """Levenshtein automata (with swaps of neighbours) of many terms, as one automaton over their trie.

    ``terms``: text, whether it is a beginning (what follows doesn't matter), and the edits allowed. A state is the set
    of (node, edits, letter still due of a swap); ``find`` gives the term with the fewest edits, or None.
    """

    def __init__(self, terms: list[tuple[str, bool, int]]) -> None:
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [-1]  # edits allowed to any term below
        for k, (text, _, most) in enumerate(terms):
            at = 0
            self.reach[0] = max(self.reach[0], most)
            for c in text:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.reach.append(-1)
                at = self.next[at][c]
                self.reach[at] = max(self.reach[at], most)
            self.ends[at].append(k)
        self._forget()

    def _forget(self) -> None:
        self.steps: dict[tuple, tuple] = {}
        self.known: dict[str, tuple[int, int] | None] = {}
        self.start = self._closed({(0, 0, "")})

    def _closed(self, points: set) -> tuple:
        """The state of these points and those that leaving out letters of a term leads to."""
        left, seen = list(points), set(points)
        while left:
            node, e, due = left.pop()
            if not due:
                for child in self.next[node].values():
                    p = (child, e + 1, "")
                    if e < self.reach[child] and p not in seen:
                        seen.add(p)
                        left.append(p)
        return tuple(sorted(seen))

    def _ended(self, state: tuple, whole: bool) -> tuple[int, int] | None:
        """The fewest edits and their term at the end of a word (``whole``), or of beginnings met so far."""
        found = [(e, k) for node, e, due in state if not due for k in self.ends[node] if e <= self.terms[k][2] and (whole or self.terms[k][1])]
        return min(found, default=None)

    def _step(self, state: tuple, c: str) -> tuple:
        out = set()
        for node, e, due in state:
            if due:
                if c == due:
                    out.add((node, e, ""))
                continue
            more = e < self.reach[node]
            if more:
                out.add((node, e + 1, ""))
            for d, child in self.next[node].items():
                if d == c:
                    out.add((child, e, ""))
                elif e < self.reach[child]:
                    out.add((child, e + 1, ""))
                    over = self.next[child].get(c)
                    if over is not None and e < self.reach[over]:
                        out.add((over, e + 1, d))
        new = self._closed({p for p in out if p[1] <= self.reach[p[0]]})
        return new, self._ended(new, False), self._ended(new, True)

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, ties to the first; None without any."""
        if word in self.known:
            return self.known[word]
        if len(self.known) + len(self.steps) > CACHE:
            self._forget()
        state, best, whole = self.start, None, None
        for c in word:
            key = (state, c)
            got = self.steps.get(key)
            if got is None:
                got = self.steps[key] = self._step(state, c)
            state, early, whole = got
            if early is not None and (best is None or early < best):
                best = early
            if not state:
                break
        if state and whole is not None and (best is None or whole < best):
            best = whole
        self.known[word] = best
        return best


def quoted(text: str, begin: int, end: int, words: int = CONTEXT) -> bool:
    """Whether a quotation of at most so many words each side of text[begin:end], on one line, holds it."""
    reach = 12 * words
    line = text.rfind("\n", max(0, begin - reach), begin) + 1
    before = text[max(line, begin - reach, 0) : begin]
    stop = text.find("\n", end, end + reach)
    after = text[end : stop if stop >= 0 else end + reach]
    for mark, closing in QUOTES.items():
        at = before.rfind(mark)
        if at < 0 or len(before[at:].split()) > words + 1:
            continue
        if mark in closing:
            if before.count(mark) % 2 == 0:
                continue
        elif any(x in before[at:] for x in closing):
            continue
        ends = [after.find(x) for x in closing if x in after]
        if ends and len(after[: min(ends)].split()) <= words + 1:
            return True
    return False


#: Of a text: 1; log sums of open exact, open misspelled and quoted hits; the most open hits in one context; their share.
PRIOR = np.array([-4.0, 4.0, 3.5, 0.5, 0.8, 0.3])
#: How firmly the prior holds each weight.
FIRM = np.array([0.02, 0.05, 0.5, 2.0, 0.5, 0.5])


def features(text: str, automaton: Automaton) -> np.ndarray:
    """The sums that a text is scored by."""
    out = np.zeros(len(PRIOR))
    out[0] = 1
    low = text.lower()
    find, known, hits = automaton.find, automaton.known, set()
    for w in set(WORD.findall(low)):
        got = known[w] if w in known else find(w)
        if got is not None:
            hits.add(w)
    if not hits:
        return out
    spans = list(WORD.finditer(low))
    places, sums = [], [0, 0, 0]
    for k, m in enumerate(spans):
        if m[0] in hits:
            if quoted(low, m.start(), m.end()):
                sums[2] += 1
            else:
                sums[int(find(m[0])[0] > 0)] += 1
                places.append(k)
    out[1:4] = np.log1p(sums)
    if places:
        at = np.array(places)
        out[4] = np.log1p(np.searchsorted(at, at + CONTEXT, side="right") - np.arange(len(at))).max()
        out[5] = math.log1p(100 * len(places) / len(spans))
    return out


def learn_terms(toxic: list[str], clean: list[str], share: float) -> list[tuple[str, bool, int]]:
    """Terms of the lexicon: words and beginnings that stand in ``toxic`` texts and hardly in ``clean`` ones.

    Support is the smaller of the texts and of the different left neighbours that a term has. ``share``: of toxic texts.
    """
    docs, clear, left, whole = Counter(), Counter(), defaultdict(set), Counter()

    def keys(word: str) -> Iterable[tuple[str, bool]]:
        yield word, False
        for n in range(SHORTEST, min(len(word), 9)):
            yield word[:n], True

    for text in toxic:
        words = WORD.findall(text.lower())
        docs.update({key for w in set(words) if len(w) >= SHORTEST for key in keys(w)})
    docs = Counter({k: n for k, n in docs.items() if n * -math.log(share) >= EVIDENCE})
    for text in clean:
        clear.update({key for w in set(WORD.findall(text.lower())) if len(w) >= SHORTEST for key in keys(w) if key in docs})
    rate = CLEAN * len(clean) / max(1, len(toxic))
    docs = {k: n for k, n in docs.items() if clear[k] <= rate * n}
    for text in toxic:
        words = WORD.findall(text.lower())
        for before, w in zip(["", *words], words, strict=False):
            for key in keys(w):
                if key in docs:
                    left[key].add(before)
                    whole[w] += key == (w, False)
    fine = {k: min(n, len(left[k])) for k, n in docs.items() if min(n, len(left[k])) * -math.log(share) >= EVIDENCE}
    out = []
    stems = sorted((t for t, stem in fine if stem), key=len)
    taken: list[str] = []
    for s in stems:
        if any(s.startswith(t) for t in taken):
            continue
        # the longest beginning that stands in as many texts says most; a word that is all of it is a word, not a beginning
        longer = max((t for t in stems if t.startswith(s) and fine[(t, True)] >= 0.98 * fine[(s, True)]), key=len)
        words = [w for w, stem in fine if not stem and w.startswith(s)]
        if any(fine[(w, False)] >= 0.9 * fine[(s, True)] for w in words):
            continue
        taken.append(longer)
        out.append((fine[(longer, True)], longer, True))
    out += [(n, w, False) for (w, stem), n in fine.items() if not stem and not any(w.startswith(t) for t in taken)]
    return [(w, stem, most_edits(w)) for _, w, stem in sorted(out, key=lambda x: (-x[0], x[1]))[:TERMS]]


def fitted_edits(terms: list[tuple[str, bool, int]], clean: list[str]) -> list[tuple[str, bool, int]]:
    """The terms, each with as many edits as ``clean`` texts hardly meet."""
    automaton, met = Automaton(terms), [Counter(), Counter()]
    for text in clean:
        found = {automaton.find(w) for w in set(WORD.findall(text.lower()))} - {None}
        for least in (1, 2):
            met[least - 1].update({k for e, k in found if e == least})
    limit = LOOSE * len(clean)
    return [(w, stem, next((e - 1 for e in range(1, most + 1) if met[e - 1][k] > limit), most)) for k, (w, stem, most) in enumerate(terms)]


def learn(texts: list[str], labels: list[int], totals: tuple[int, int]) -> dict:
    """A model: the terms and the weights. ``totals``: labelled rows of label 0 and 1, of which the texts are a sample."""
    toxic, clean = ([t for t, y in zip(texts, labels, strict=True) if y == k] for k in (1, 0))
    weights = PRIOR.copy()
    if not toxic or not clean:
        share = (totals[1] + 0.5) / (sum(totals) + 1)
        weights[0] = math.log(share / (1 - share))
        return {"terms": [], "weights": weights}
    terms = fitted_edits(learn_terms(toxic, clean, len(toxic) / len(texts)), clean)
    automaton = Automaton(terms)
    x, y = np.stack([features(t, automaton) for t in texts]), np.array(labels, float)
    each = np.where(y == 1, totals[1] / len(toxic), totals[0] / len(clean))
    each *= len(texts) / each.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        grad = x.T @ (each * (y - p)) - FIRM * (weights - PRIOR)
        hessian = (x * (each * p * (1 - p))[:, None]).T @ x + np.diag(FIRM)
        weights = weights + np.clip(np.linalg.solve(hessian, grad), -1, 1)
    return {"terms": terms, "weights": np.maximum(weights, [-30, 0, 0, 0, 0, 0])}


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 0 on division by 5 (null id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> dict:
    """A model of at most ``sample`` labelled texts of each label, the first by a hash of their id, none held out.

    Texts of ``sample_chars`` characters or more are scored like all but not learnt from. An id with two labels counts
    as toxic. Without texts of both labels every text gets the share of label 1 (0.5 without any labels).
    """
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.length("text") < sample_chars)
    found = known.join(text.select("doc_id").distinct(), "doc_id")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = lambda y: found.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = draw(0).unionByName(draw(1))
    # at most 2 * sample ids
    rows = text.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return learn([r.text for r in rows], [r.toxic for r in rows], (counts.get(0, 0), counts.get(1, 0)))


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on) of every document.

    Scores see the whole text and nothing else. Null and empty texts get the score of a text without hits. Null ids
    and repeated rows each return; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed)
        automaton, weights = Automaton(own["terms"]), own["weights"]
        for batch in pieces(batches, "text"):
            x = np.stack([features(t or "", automaton) for t in batch.column("text").to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield arrow_rows(SCORES, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), score=p)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
