"""Harmonic packing into sequences of ``CAPACITY`` tokens.

A document longer than a sequence gives up whole sequences of itself; the part after them, and any shorter document, is
an item. Items are dealt to shards ("workers") of about ``SHARD`` tokens. Each shard puts its items into the reciprocal
classes, class k holding lengths over CAPACITY / (k + 1) up to CAPACITY / k, and fills a class's bins with k items each.
The gap that remains in a bin is closed: first by loose items (of no class, or too few for a bin) that fit it whole,
tightest gap first, then by whole sequences of long documents, cut for the purpose. Where a shard has too little for
its gaps, the bins with the widest ones are loosened. What is still loose fills sequences of its own, and the last of it
is cut into lengths that are powers of two, so no sequence is padded.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import tokens
from riskloom.llm.common import arrow_rows, pieces, ship, stage

CAPACITY, CLASSES, END = 2048, 32, 1
SHARD = 128 * CAPACITY
# Bytes of text encoded, and of ids sent, at once: an executor holds several such chunks for each of its cores.
CHUNK = 2 << 20

CUTS = pa.schema([("place", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sequences of long documents, and items. ``place`` numbers them, so that equal ones can be dealt apart."""
    place = TaskContext.get().partitionId() << 40
    end_id = np.uint32(END)
    rows: dict[str, list] = {f.name: [] for f in CUTS}
    held, pool = 0, pa.default_memory_pool()
    for batch in pieces(batches, "text", CHUNK):
        ids, counts = tokens.encode(batch.column("text"))
        pool.release_unused()  # a worker would keep what splitting took, besides the JVM's own
        begin = 0
        for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
            own = np.append(ids[begin : begin + n], end_id).astype("<u4")
            begin += n
            for at in range(0, n + 1, CAPACITY):
                part = own[at : at + CAPACITY]
                packed = part.astype("<u2" if part.max() < 1 << 16 else "<u4").tobytes()  # two bytes an id where they do
                for c, value in zip(CUTS.names, (place, doc_id, at, len(part), n + 1, packed), strict=True):
                    rows[c].append(value)
                place, held = place + 1, held + len(packed)
                if held >= CHUNK:
                    yield arrow_rows(CUTS, **rows)
                    rows, held = {f.name: [] for f in CUTS}, 0
    yield arrow_rows(CUTS, **rows)


def fill(lengths: list[int], whole: list[bool], capacity: int = CAPACITY, classes: int = CLASSES) -> list[list[tuple[int, int, int]]]:
    """The sequences of a shard, each a list of (item, from, to), full or as long as a power of two.

    ``whole`` marks the sequences cut from long documents; other items stay in one piece where they can.
    """
    by_class: dict[int, list[int]] = defaultdict(list)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if not whole[i]:
            by_class[capacity // lengths[i]].append(i)
    bins, loose = [], []
    for k, own in by_class.items():
        full = len(own) // k * k if k <= classes else 0
        bins += [own[a : a + k] for a in range(0, full, k)]
        loose += own[full:]
    gap = lambda own: capacity - sum(lengths[i] for i in own)
    bins.sort(key=gap)
    spare = [i for i, w in enumerate(whole) if w]
    missing = sum(map(gap, bins)) - sum(lengths[i] for i in loose + spare)
    while missing > 0:  # a loosened bin has no gap, and its items fill those of others
        loose += bins[-1]
        missing -= capacity
        bins.pop()
    gaps = sorted((gap(own), b) for b, own in enumerate(bins))
    rest = []
    for i in sorted(loose, key=lambda i: (-lengths[i], i)):
        at = bisect_left(gaps, (lengths[i], -1))
        if at == len(gaps):
            rest.append(i)
        else:
            size, b = gaps.pop(at)
            bins[b].append(i)
            insort(gaps, (size - lengths[i], b))
    used = min(len(spare), -(-sum(size for size, _ in gaps) // capacity))
    tape = deque((i, 0, lengths[i]) for i in spare[:used] + rest)

    def take(n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            i, a, b = tape.popleft()
            cut = min(b, a + n)
            out.append((i, a, cut))
            n -= cut - a
            if cut < b:
                tape.appendleft((i, cut, b))
        return out

    left = {b: size for size, b in gaps}
    out = [[(i, 0, lengths[i]) for i in own] + take(left[b]) for b, own in enumerate(bins)]
    out += [[(i, 0, lengths[i])] for i in spare[used:]]
    if tape and whole[tape[0][0]]:
        tape.rotate(-1)  # the cuts at the end had better go through a long document
    over = sum(b - a for _, a, b in tape)
    out += [take(capacity) for _ in range(over // capacity)]
    return out + [take(1 << k) for k in reversed(range(capacity.bit_length() - 1)) if over % capacity >> k & 1]


def _packed(key: tuple, shard: pa.Table) -> pa.Table:
    """The pieces of a shard."""
    columns = [shard.column(c).to_pylist() for c in CUTS.names[1:]]
    rows = sorted(zip(*columns, strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    first = key[0].as_py() << 32
    out: dict[str, list] = {f.name: [] for f in PIECES}
    for number, parts in enumerate(fill([r[2] for r in rows], [r[2] == CAPACITY < r[3] for r in rows])):
        offset = 0
        for i, a, b in parts:
            doc_id, start, length, doc_tokens, packed = rows[i]
            ids = np.frombuffer(packed, f"<u{len(packed) // length}")[a:b].astype("<u4")
            values = (doc_id, start + a, b - a, zlib.crc32(ids.tobytes()), doc_tokens, first + number, offset)
            for c, value in zip(PIECES.names, values, strict=True):
                out[c].append(value)
            offset += b - a
    return pa.Table.from_batches([arrow_rows(PIECES, **out)])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of the end id alone. Null ids are kept as null; repeated rows are packed each,
    and dealt to shards by their places, so no shard outgrows ``shard_tokens`` by many copies of one row. Other columns
    are ignored; an empty table gives no rows. Reruns over the same files give the same rows.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "place long, doc_id long, start long, length long, doc_tokens long, ids binary"
    made = stage(slim.mapInArrow(_cuts, schema), "pack-cuts")
    total = made.agg(F.sum("length")).first()[0] or 0
    dealt = made.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(max(1, -(-total // shard_tokens)))))
    return dealt.groupBy("shard").applyInArrow(_packed, ", ".join(f"{c} long" for c in PIECES.names))
