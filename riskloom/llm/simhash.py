"""SimHash near-duplicates: byte-position inverted index, count filter, verification.

Two 64-bit fingerprints at 3 or fewer differing bits share at least 5 of their 8 positional bytes. Lists of single
bytes would hold 1/256 of all fingerprints each, so lists are keyed by three positional bytes: of any 5 positions at
least 3 lie in the same half, so the 4 + 4 triples of the halves (bytes 0-3, bytes 4-7) meet every pair that can
pass. Pairs of a list are tallied by their shared positional bytes, kept from 5 on, then verified bit by bit. Lists of
over ``LIST`` fingerprints are dealt again by the triple and two more bytes (a linked pair shares at least 5), and
from any list only the links of a spanning forest leave: connectivity is exact, quadratic output never arises.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import similar
from riskloom.llm.common import arrow_rows, perhaps_in, pieces, ship, stage, unused
from riskloom.llm.graph import stars

BITS, SHARED, SEED, WORDS = 3, 5, 42, 3
LIST = 4096
HALVES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
FINE = [(k, *pair) for k, triple in enumerate(HALVES) for pair in combinations([p for p in range(8) if p not in triple], 2)]


def _mask(positions: tuple[int, ...]) -> int:
    bits = sum(0xFF << (8 * p) for p in positions)
    return bits - (1 << 64) if bits >> 63 else bits


MASKS = [_mask(t) for t in HALVES]
FINE_MASKS = [_mask((*HALVES[k], *pair)) for k, *pair in FINE]


def simhash(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes ``h``; 0 for none."""
    tally = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        tally += _tally(h[at : at + (1 << 15)])
    return _majority(tally, len(h))


def _tally(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)


def _majority(tally: np.ndarray, n: int) -> int:
    return int(np.packbits(tally * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """SimHash of lower-cased (A-Z) word shingles, repeats included; 0 for a text without words."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) < words:
        return hashed(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    del found
    tally, n = np.zeros(64, np.int64), len(ends) - words + 1
    for at in range(0, n, 1 << 15):
        upto = min(n, at + (1 << 15))
        h = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[at:upto].tolist(), ends[at + words - 1 : upto + words - 1].tolist(), strict=True)], np.uint64)
        tally += _tally(h)
    return _majority(tally, n)


FP_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        fps = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column("text")], np.uint64)
        yield arrow_rows(FP_SCHEMA, doc_id=batch.column("doc_id"), fp=fps.view(np.int64))


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The count filter (5 shared positional bytes), then the verified distance."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1) >= SHARED
    return shared & (np.bitwise_count(x) <= BITS)


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among ``fps`` (distinct): one less than the nodes of each component."""
    a, b, rest = [], [], fps
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            for node in (front := queue.pop()):
                hit = linked(np.full(len(rest), node, np.uint64), rest)
                if hit.any():
                    new = rest[hit]
                    a.append(np.full(len(new), node, np.uint64))
                    b.append(new)
                    queue.append(new)
                    rest = rest[~hit]
                    if not len(rest):
                        break
            del front
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.uint64),) * 2


def cube_forest(fps: np.ndarray, free: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """As forest() for a long list whose fingerprints differ in three bytes only: labels spread in the cube of 2^24
    points, so memory has a bound whatever the list."""
    point = np.zeros(len(fps), np.int64)
    for k, p in enumerate(free):
        point |= ((fps >> np.uint64(8 * p)) & np.uint64(0xFF)).astype(np.int64) << (8 * k)
    none = np.int32(1 << 30)
    label, cube = np.arange(len(fps), dtype=np.int32), np.empty(1 << 24, np.int32)
    while True:
        cube.fill(none)
        cube[point] = label
        for _ in range(BITS):
            wide = cube.copy()
            for bit in range(24):
                pairs, out = cube.reshape(-1, 2, 1 << bit), wide.reshape(-1, 2, 1 << bit)
                np.minimum(out, pairs[:, ::-1], out=out)
            cube = wide
        new = cube[point]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[label[child]], fps[child]


LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("fine", pa.int32())])


def _rows(a: np.ndarray, b: np.ndarray, fine: np.ndarray | None = None) -> pa.RecordBatch:
    return arrow_rows(LINK_SCHEMA, a=a.view(np.int64), b=b.view(np.int64), fine=np.full(len(a), -1, np.int32) if fine is None else fine)


def _overflow(fps: np.ndarray, k: int) -> pa.RecordBatch:
    """Postings of a long list by the triple and two more bytes: a is the fingerprint, b its finer key."""
    own = [j for j, f in enumerate(FINE) if f[0] == k]
    a = np.tile(fps, len(own))
    b = np.concatenate([fps & np.uint64(FINE_MASKS[j] & (2**64 - 1)) for j in own])
    return _rows(a, b, np.repeat(np.array(own, np.int32), len(fps)))


def _search(last: bool):
    """Over rows sorted by (k, v, fp): yields links, and from lists of over LIST, unless ``last``, finer postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, spilling = None, [], False

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, spilling
            fps = np.concatenate(held) if held else np.empty(0, np.uint64)
            if spilling and len(fps):
                yield _overflow(fps, held_key[0])
            elif len(fps) > 1:
                if last and len(fps) > 16 * LIST:
                    fine = FINE[held_key[0]]
                    yield _rows(*cube_forest(fps, tuple(p for p in range(8) if p not in (*HALVES[fine[0]], *fine[1:]))))
                else:
                    yield _rows(*forest(fps))
            held, spilling = [], False

        for batch in batches:
            k, v = batch.column("k").to_numpy(), batch.column("v").to_numpy()
            fp = batch.column("fp").to_numpy().view(np.uint64)
            cut = np.concatenate(([0], np.nonzero((k[1:] != k[:-1]) | (v[1:] != v[:-1]))[0] + 1, [len(k)]))
            small = [[], []]
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                key = (int(k[s]), int(v[s]))
                if key != held_key or e == len(k):
                    if key != held_key:
                        yield from close()
                        held_key = key
                    if e < len(k) and e - s <= LIST:
                        if e - s == 2:
                            small[0].append(s)
                        elif e - s > 2:
                            yield _rows(*forest(fp[s:e]))
                        held_key = None
                        continue
                held.append(fp[s:e])
                if not last and sum(map(len, held)) > LIST:
                    spilling = True
                    yield _overflow(np.concatenate(held), key[0])
                    held = []
            if small[0]:
                at = np.array(small[0])
                ok = linked(fp[at], fp[at + 1])
                yield _rows(fp[at[ok]], fp[at[ok] + 1])
        yield from close()

    return run


def links(fps: DataFrame) -> DataFrame:
    """Distinct ``fp`` to links (a, b) whose components are those of all pairs at 3 or fewer differing bits."""
    postings = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(m).alias("v")) for k, m in enumerate(MASKS)])).alias("x"))
    postings = postings.select(F.col("x.k").alias("k"), F.col("x.v").alias("v"), "fp")
    found = stage(postings.repartition("k", "v").sortWithinPartitions("k", "v", "fp").mapInArrow(_search(False), "a long, b long, fine int"), "simhash-links")
    fine = found.where("fine >= 0").select(F.col("fine").alias("k"), F.col("b").alias("v"), F.col("a").alias("fp"))
    more = fine.repartition("k", "v").sortWithinPartitions("k", "v", "fp").mapInArrow(_search(True), "a long, b long, fine int")
    return found.where("fine < 0").select("a", "b").union(more.select("a", "b"))


def _grouped(distinct: DataFrame, linked: DataFrame) -> DataFrame:
    """fp, least, root of its component under the links (a, b), for each distinct fp."""
    return distinct.join(stars(linked), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id keep their row; their
    component's id is the smallest id in it, null if it has none. Repeated rows each return. Other columns are ignored.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    fps = stage(slim.mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash-fp")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    grouped = _grouped(distinct, links(distinct.select("fp")))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(smallest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ROWS = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("set", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("leading", pa.list_(pa.int64()))])


def _near(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct ``sets`` (set, fp) whose fingerprints differ in 3 bits or fewer: those of one fingerprint
    meet its least set, and these least ones each other by links()."""
    least = stage(sets.groupBy("fp").agg(F.min("set").alias("least")), "similar-fp")
    a, b = (least.select(F.col("fp").alias(c), F.col("least").alias(f"of_{c}")) for c in ("a", "b"))
    apart = links(least.select("fp")).distinct().join(a, "a").join(b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    one = sets.select("set", "fp").join(least, "fp").where("set <> least").select(F.col("set").alias("a"), F.col("least").alias("b"))
    return apart.union(one).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that come first in their component: by doc_id (null last), then
    the hash of their text. Of rows alike in both one stays. Linked are texts whose sets of five-word shingles are
    alike by 0.8 or more. SimHash finds them first: fingerprints of these sets, the index of byte positions, the count
    filter, 3 bits at most, then the exact check of the sets. Pairs whose fingerprints are further apart, which no
    radius of such an index can promise, follow by their leading shingles, among what is not linked yet. Null and
    empty texts have the empty set and are copies of each other; an empty table gives no rows; other columns, whatever
    their names, pass unread."""
    ship(docs.sparkSession)
    common, rank = similar.common_shingles(docs, docs.count())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t1"), "text")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [similar.shingles((t or "").encode()) for t in batch.column("text").to_pylist()]
            own = np.array([similar.identity(x) for x in found], np.uint64).view(np.int64)
            fps = np.array([simhash(x) for x in found], np.uint64).view(np.int64)
            pa.default_memory_pool().release_unused()
            leading = [similar.leading(x, common, rank).view(np.int64) for x in found]
            yield arrow_rows(ROWS, doc_id=batch.column("doc_id"), t1=batch.column("t1"), set=own, n=[len(x) for x in found], fp=fps, leading=leading)

    rows = stage(texts.mapInArrow(keyed, "doc_id long, t1 long, set long, n long, fp long, leading array<long>"), "similar-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1")).alias("first")
    sets = stage(rows.groupBy("set").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("leading").alias("leading"), least), "similar-leading")
    roots = stars(similar.links(texts, sets, stage(_near(sets), "similar-near")))
    grouped = sets.select("set", "first").join(roots, F.col("set") == F.col("node"), "left").select("first", F.coalesce("root", "set").alias("root"))
    winners = stage(grouped.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("w_doc"), F.col("first.t1").alias("w_t1")), "similar-winners")
    won = lambda df, t1: df["doc_id"].eqNullSafe(winners["w_doc"]) & (df[t1] == winners["w_t1"])
    counted = rows.groupBy("doc_id", "t1").count()
    doubtful = counted.where("count = 1").join(winners, won(counted, "t1"), "left_anti").union(counted.where("count > 1"))
    # rows that surely stay aren't shuffled; the others meet the winners
    own = unused(docs, "own")
    key = lambda doc, t1: F.xxhash64(F.col(doc).cast("long"), F.col(t1))
    marked = docs.withColumn(f"{own}_t1", F.xxhash64("text")).withColumn(f"{own}_key", key("doc_id", f"{own}_t1"))
    marked = perhaps_in(marked, f"{own}_key", doubtful.select(key("doc_id", "t1").alias("key")), f"{own}_met")
    met = marked.where(f"`{own}_met`").dropDuplicates(["doc_id", f"{own}_t1"])
    return marked.where(f"NOT `{own}_met`").union(met.join(winners, won(met, f"{own}_t1"), "left_semi")).select(*docs.columns)
