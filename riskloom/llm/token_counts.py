"""Edit-aware token counts: a tree of segment sums per document, re-encoding only what an edit touches.

A document's segments end at safe places: a space between two non-space characters always begins a pre-token, so the
tokens of a text are those of its segments. Each segment is a leaf with its characters and tokens; inner nodes hold
sums. An edit finds its leaves by descent, re-encodes them with their boundary context (the character before it, and
neighbours as long as an end has become unsafe), and mends the sums above. The end-of-text string counts as plain text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import tokens
from riskloom.llm.common import arrow_rows, pieces, ship

SEGMENT = 256
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Stretches of at least ``size`` characters that end at safe places."""
    out, at = [], 0
    while hit := _SAFE.search(text, at + size):
        out.append(text[at : hit.start()])
        at = hit.start()
    return [*out, text[at:]] if at < len(text) else out


def count(text: str) -> int:
    return len(tokens.ranked()[0].encode_ordinary(text))


class Sums:
    """A binary tree of sums over leaves: prefix search, point update and re-growth."""

    def __init__(self, leaves: list[int]):
        self.n = 1 << max(0, (len(leaves) - 1).bit_length())
        self.tree = [0] * self.n + leaves + [0] * (self.n - len(leaves))
        for k in range(self.n - 1, 0, -1):
            self.tree[k] = self.tree[2 * k] + self.tree[2 * k + 1]

    def set(self, leaf: int, value: int) -> None:
        k = leaf + self.n
        change = value - self.tree[k]
        while k and change:
            self.tree[k] += change
            k //= 2

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds ``place`` and the sum before it; past the end, the last place a leaf can have."""
        k, before = 1, 0
        while k < self.n:
            k *= 2
            if place - before >= self.tree[k]:
                before += self.tree[k]
                k += 1
        return k - self.n, before

    @property
    def total(self) -> int:
        return self.tree[1]


class Document:
    """A text as segments, with trees over their characters and tokens."""

    def __init__(self, text: str, leaf_chars: list[int] | None = None, leaf_tokens: list[int] | None = None):
        if leaf_chars is None or sum(leaf_chars) != len(text):
            self.leaves = segments(text)
            leaf_tokens = [count(x) for x in self.leaves]
        else:
            ends = [sum(leaf_chars[:1])]
            for n in leaf_chars[1:]:
                ends.append(ends[-1] + n)
            self.leaves = [text[e - n : e] for e, n in zip(ends, leaf_chars, strict=False)] if leaf_chars else []
        self.encoded = 0
        self._grow(list(map(len, self.leaves)), list(leaf_tokens or []))

    def _grow(self, chars: list[int], counts: list[int]) -> None:
        self.counts, self.chars, self.tokens = counts, Sums(chars), Sums(counts)

    def text(self) -> str:
        return "".join(self.leaves)

    def edit(self, start: int, drop: int, insert: str) -> None:
        """Replace ``drop`` characters from ``start`` (both cut to the text) by ``insert``."""
        size = self.chars.total
        start = min(max(start, 0), size)
        drop = min(max(drop, 0), size - start)
        if not drop and not insert:
            return
        last = max(len(self.leaves) - 1, 0)
        a, before = self.chars.find(max(start - 1, 0)) if self.leaves else (0, 0)
        b = min(self.chars.find(start + drop)[0], last) if self.leaves else -1
        a = min(a, last)
        joined = "".join(self.leaves[a : b + 1])
        new = joined[: start - before] + insert + joined[start - before + drop :]
        while a > 0 and not (len(new) > 1 and new[0] == " " and not new[1].isspace()):
            a -= 1
            new = self.leaves[a] + new
        while b < last and self.leaves and (not new or new[-1].isspace()):
            b += 1
            new += self.leaves[b]
        fresh = segments(new)
        counts = [count(x) for x in fresh]
        self.encoded += len(new)
        if len(fresh) == b + 1 - a:
            self.leaves[a : b + 1] = fresh
            for k, (x, n) in enumerate(zip(fresh, counts, strict=True), a):
                self.counts[k] = n
                self.chars.set(k, len(x))
                self.tokens.set(k, n)
        else:
            self.leaves[a : b + 1] = fresh
            self._grow(list(map(len, self.leaves)), self.counts[:a] + counts + self.counts[b + 1 :])


STATE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("edits", pa.list_(pa.struct([("start", pa.int64()), ("drop", pa.int64()), ("insert", pa.string())]))), ("leaf_chars", pa.list_(pa.int32())), ("leaf_tokens", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("n_tokens_before", pa.int64()), ("n_chars", pa.int64()), ("n_encoded", pa.int64())])
EDITS = "array<struct<start: long, drop: long, insert: string>>"
DDL = f"doc_id long, text string, edits {EDITS}, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long, n_tokens_before long, n_chars long, n_encoded long"


def _run(apply: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = {f.name: [] for f in STATE}
            known = "leaf_chars" in batch.schema.names
            for row in batch.to_pylist():
                doc = Document(row["text"] or "", row["leaf_chars"] if known else None, row["leaf_tokens"] if known else None)
                before = doc.tokens.total
                if apply:
                    for e in row["edits"] or []:
                        if e is not None:
                            doc.edit(e["start"] or 0, e["drop"] or 0, e["insert"] or "")
                text = doc.text() if apply else row["text"]
                new = [row["doc_id"], text, row["edits"], list(map(len, doc.leaves)), doc.counts, doc.tokens.total, before, doc.chars.total, doc.encoded if apply else len(text or "")]
                for to, value in zip(rows.values(), new, strict=True):
                    to.append(value)
            yield arrow_rows(STATE, **rows)

    return run


def build(docs: DataFrame) -> DataFrame:
    """The state of ``docs`` (doc_id, text, and edits if there are any): its text, leaves and n_tokens.

    Null and empty texts have no leaves and no tokens. Null ids and repeated rows each keep their row.
    """
    ship(docs.sparkSession)
    edits = F.col("edits") if "edits" in docs.columns else F.lit(None)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.cast(EDITS).alias("edits"))
    return slim.mapInArrow(_run(False), DDL)


def apply(state: DataFrame) -> DataFrame:
    """``state`` after its edits, in their order; each edit's start and drop count characters of the text it meets.

    n_tokens_before is the count before them, n_encoded the characters that were encoded again. Null parts of an edit are 0 or empty; starts and drops
    beyond the text are cut to it.
    """
    ship(state.sparkSession)
    return state.select(*[f.name for f in STATE]).mapInArrow(_run(True), DDL)


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """``state`` with ``edits`` (doc_id, seq, start, drop, insert) of each document in order of seq."""
    one = F.struct(F.col("seq"), F.col("start").cast("long").alias("start"), F.col("drop").cast("long").alias("drop"), F.col("insert"))
    lists = edits.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["start"].alias("start"), x["drop"].alias("drop"), x["insert"].alias("insert"))).alias("edits"))
    return state.drop("edits").join(lists, "doc_id", "left")


def revision(text: F.Column) -> F.Column:
    """The edits of the query: a mark before the text, a word in its first third, a cut in its second."""
    n = F.length(F.coalesce(text, F.lit("")))
    edit = lambda start, drop, insert: F.struct(start.cast("long").alias("start"), F.lit(drop).cast("long").alias("drop"), F.lit(insert).alias("insert"))
    return F.array(edit(F.lit(0), 0, "# "), edit(F.floor(n / 3), 0, " amended "), edit(F.floor(n * 2 / 3), 40, "\n"))
