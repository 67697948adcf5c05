"""Pairs of texts whose sets of five-word shingles are alike by 0.8 or more (Jaccard), all of them.

Pairs that fingerprints bring near (``simhash.py``) are checked first; what they leave apart goes through lists.
Two such sets share a shingle among the first n // 5 + 1 of each in any order common to all, so lists are keyed by
these. In that order rare shingles come first; those that a sample holds more than once come last, so that a passage
of many texts makes no list. A list pairs what its sizes and places allow, and a pair counts once its whole sets were
compared. Lists of over ``FEW`` sets are chained first, then only what is still apart is paired: nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_rows, perhaps_in, pieces, shuffles_freed, stage
from riskloom.llm.graph import stars

WORDS, SEED = 5, 42
SAMPLE, COMMON, FEW = 16_384, 1 << 17, 64


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of lower-cased (A-Z) shingles; of a shorter text the one of all its words."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts, words = np.concatenate(([0], ends[:-1] + 1)).tolist(), min(WORDS, len(found))
    ends = ends.tolist()
    return np.unique(np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[: len(ends) - words + 1], ends[words - 1 :], strict=True)], np.uint64))


def identity(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def leading(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1: rare ones by their hash, then those in ``common`` (sorted) by ``rank``."""
    many = len(found) // 5 + 1
    if not len(common):
        return found[:many]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    known = common[at] == found
    rare = found[~known]
    if len(rare) < many:
        rare = np.concatenate((rare, found[known][np.argsort(rank[at[known]], kind="stable")]))
    return rare[:many]


SETS = pa.schema([("set", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 1 << 20):
        found = [shingles((t or "").encode()) for t in batch.column("text").to_pylist()]
        pa.default_memory_pool().release_unused()
        yield arrow_rows(SETS, set=[np.uint64(identity(x)).view(np.int64) for x in found], shingles=[x.view(np.int64) for x in found])


def common_shingles(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that about ``SAMPLE`` texts hold more than once, sorted, and their rank from rare to common."""
    few = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(max(1, rows // SAMPLE))) == 0).distinct()
    sets = few.mapInArrow(_sets, "set long, shingles array<long>")
    counts = sets.select(F.explode("shingles").alias("s")).groupBy("s").count().where("count > 1")
    with shuffles_freed(docs.sparkSession):
        top = counts.orderBy(F.desc("count"), "s").limit(COMMON).toArrow()
    common = top.column("s").to_numpy().view(np.uint64)
    order = np.argsort(common)
    return common[order], (len(common) - np.arange(len(common)))[order].astype(np.int32)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])
COLUMNS = ("key", "set", "n", "at", "root")


def _pairs(few: int | None) -> Callable:
    """Over rows sorted by (key, n, set): pairs (a, b) that can be alike and whose roots differ. With ``few`` longer
    lists give only neighbours and their key."""

    def close(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, own, n, at, root = rows
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(cut)
        longer = np.repeat(size > few, size) if few else np.zeros(len(key), bool)
        if longer.any():
            keys = np.unique(key[longer])
            yield arrow_rows(PAIRS, a=[None] * len(keys), b=[None] * len(keys), key=keys)
        left = np.repeat(cut[1:], size) - np.arange(len(key))
        for step in range(1, int(size.max())):
            i = np.flatnonzero((left > step) & ~longer) if step > 1 else np.flatnonzero(left > step)
            j = i + step
            ok = (root[i] != root[j]) & (5 * n[i] >= 4 * n[j]) & (9 * np.minimum(n[i] - at[i], n[j] - at[j]) >= 4 * (n[i] + n[j]))
            if ok.any():
                a, b = own[i[ok]], own[j[ok]]
                yield arrow_rows(PAIRS, a=np.minimum(a, b), b=np.maximum(a, b), key=[None] * len(a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in COLUMNS]
            if not len(rows[0]):
                continue
            if rows[0][0] == rows[0][-1] and (not held or held[-1][0][-1] == rows[0][0]):
                held.append(rows)
                continue
            rows = [np.concatenate(x) for x in zip(*held, rows, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield from close([x[:last] for x in rows])
            held = [[x[last:] for x in rows]]
        if held:
            yield from close([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _likely(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that what their leading shingles share still lets be alike.

    Of a set and the one whose leading part reaches further in the common order, all shared shingles up to the first
    one's last leading one lead in both; so the whole overlap is at most these and the first one's others.
    """
    paired = perhaps_in(sets, "set", pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "paired").where("paired")
    one, two = (paired.select(F.col("set").alias(c), F.col("n").alias(f"n_{c}"), F.col("leading").alias(f"of_{c}")) for c in ("a", "b"))
    most = F.size(F.array_intersect("of_a", "of_b")) + F.greatest(F.col("n_a") - F.size("of_a"), F.col("n_b") - F.size("of_b"))
    return stage(pairs.join(one, "a").join(two, "b").where(9 * most >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "similar-likely")


def _alike(texts: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike by 0.8 or more. Of the texts only those of these pairs are shuffled."""
    pairs = _likely(sets, pairs)
    paired = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    wanted = stage(sets.join(paired, "set", "left_semi").select(F.col("first.doc_id").alias("w_doc"), F.col("first.t1").alias("w_t1")), "similar-wanted")
    few = perhaps_in(texts, "t1", wanted.select("w_t1"), "paired").where("paired").dropDuplicates(["doc_id", "t1"])
    few = few.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("t1") == F.col("w_t1")), "left_semi").select("text")
    whole = stage(few.mapInArrow(_sets, "set long, shingles array<long>"), "similar-sets")
    one, two = (whole.select(F.col("set").alias(c), F.col("shingles").alias(f"of_{c}")) for c in ("a", "b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return stage(pairs.join(one, "a").join(two, "b").where(9 * both >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b"), "similar-links")


def _lists(sets: DataFrame) -> DataFrame:
    """The leading shingles of ``sets`` as rows of COLUMNS; root is their _root if they have one, else their set."""
    root = F.coalesce("_root", "set") if "_root" in sets.columns else F.col("set")
    rows = sets.select("set", "n", root.alias("root"), F.posexplode("leading").alias("at", "key"))
    return rows.select("key", "set", F.col("n").cast("long"), F.col("at").cast("long"), "root")


def links(texts: DataFrame, sets: DataFrame, near: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs alike by 0.8 or more.

    ``texts``: doc_id, t1, text. ``sets``: set, n, leading and ``first``, the doc_id and t1 of a text that has it
    (distinct sets). ``near``: distinct pairs (a, b), a < b, that are checked first; lists pair only what they leave apart.
    """
    shape = "a long, b long, key long"
    rooted = lambda found: found.toDF("set", "_root")
    by_key = lambda df: df.repartition("key").sortWithinPartitions("key", "n", "set")
    # each search starts from the stars of the one before, which link what its links do
    close = stars(_alike(texts, sets, near)).toDF("a", "b")
    lists = _lists(sets.join(rooted(close), "set", "left"))
    first = stage(by_key(lists).mapInArrow(_pairs(FEW), shape), "similar-pairs")
    found = close.union(_alike(texts, sets, first.where("key is null").select("a", "b").distinct()))
    longer = first.where("key is not null").select("key").distinct()
    if longer.isEmpty():
        return found
    known = stars(found).toDF("a", "b")
    again = perhaps_in(_lists(sets).drop("root"), "key", longer, "long").where("long").drop("long")
    apart = again.join(longer, "key", "left_semi").join(rooted(known), "set", "left").select(*COLUMNS[:-1], F.coalesce("_root", "set").alias("root"))
    more = stage(by_key(apart).mapInArrow(_pairs(None), shape), "similar-more").select("a", "b").distinct()
    return known.union(_alike(texts, sets, more))
