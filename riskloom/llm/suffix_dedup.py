"""Repeated passages by suffix arrays: every byte under a 400-byte string that starts anywhere else as well goes.

A suffix array of all texts would need all texts in one place, so text is first brought to where its match must be.
Each 400-byte window has an anchor: of its first ``WINDOW`` places the one whose 8 bytes hash least, the leftmost of
equals. Equal windows have equal anchors at equal offsets, and the ``KEY`` bytes from the anchor lie in the window.
The windows of one anchor are the context around it. A context that its own text repeats goes on as one row, and its
places as runs, so a text of one line over and over is a few rows. Anchors whose KEY bytes occur once end there. Where
all contexts of a key are the same, all their windows repeat. What is left, distinct contexts of one key, is put in
shards by key; each shard gets a suffix array by induced sorting and permuted common prefixes, and a window repeats if
it shares its 400 bytes with a neighbour in the array. The contexts of the most frequent keys never meet in a task:
each is cut into parts of ``STEP`` windows, which get the 385 bytes that all their windows hold as a second key; parts
that share it are counted by window. Both ways are exact at any size.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_rows, pieces, ship, stage
from riskloom.llm.suffix_array import common_prefixes, suffix_array

SPAN, WINDOW, GRAM = 400, 192, 8
KEY = SPAN - WINDOW
SEGMENT, SHARD, GROUP, STEP = 8 << 20, 1 << 20, 8 << 20, 16
# Keys of over HOT rows get second keys; the HEAVY most frequent of them (so many at most) are broadcast.
HOT, HEAVY, WINDOWS = 1024, 4096, 1 << 16


def anchors(parts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part (SPAN bytes at least, all together under 2^24): first and last window, and anchor, of each context."""
    x = np.frombuffer(b"".join(parts) + bytes(WINDOW + GRAM), np.uint8).astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | (x[k:] << np.uint64(8 * k))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x &= np.uint64(0xFFFFFFFFFF000000)
    x |= np.arange(len(x), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    x = np.minimum(x[: -(WINDOW - width)], x[WINDOW - width :]) & np.uint64(0xFFFFFF)
    out, begin = [], 0
    for part in parts:
        at = x[begin : begin + len(part) - SPAN + 1].astype(np.int64) - begin
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        first = np.concatenate(([0], cut))
        out.append((first, np.append(cut - 1, len(at) - 1), at[first]))
        begin += len(part)
    return out


# own: how often the text itself holds the context; 0: a run of windows that the text itself repeats, without a key.
CONTEXTS = pa.schema([(c, pa.int64()) for c in ("t1", "t2", "first", "last", "anchor", "own", "key", "context")])
CONTEXTS_DDL = "t1 long, t2 long, first long, last long, anchor long, own long, key long, context long"


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed = xxhash.xxh3_64_intdigest
    for batch in pieces(batches, "text", 2 << 20):
        rows: dict[str, list] = {c: [] for c in CONTEXTS.names}
        owners, parts, begins = [], [], []
        t1, t2 = batch.column("t1").to_pylist(), batch.column("t2").to_pylist()
        for k, text in enumerate(batch.column("text")):
            own = text.as_buffer().to_pybytes()
            for at in range(0, len(own) - SPAN + 1, SEGMENT):
                owners.append(k)
                begins.append(at)
                parts.append(own[at : at + SEGMENT + SPAN - 1])
        groups, size = [[]], 0
        for k, part in enumerate(parts):
            if groups[-1] and size + len(part) > SEGMENT:
                groups.append([])
                size = 0
            groups[-1].append(k)
            size += len(part)
        for group in groups:
            for k, (first, last, anchor) in zip(group, anchors([parts[k] for k in group]) if group else [], strict=True):
                part, own = parts[k], np.ones(len(first), np.int64)
                f, u, a = first.tolist(), last.tolist(), anchor.tolist()
                key = [hashed(part[c : c + KEY]) for c in a]
                context = [hashed(part[x : y + SPAN], c - x) for x, y, c in zip(f, u, a, strict=True)]
                if len(set(zip(key, context, strict=True))) < len(key):
                    places: dict[tuple[int, int], list[int]] = {}
                    for i, name in enumerate(zip(key, context, strict=True)):
                        places.setdefault(name, []).append(i)
                    runs = np.array(merged([(f[i], u[i] + SPAN) for at in places.values() if len(at) > 1 for i in at]))
                    once, none = [at[0] for at in places.values()], [0] * len(runs)
                    first, last = np.append(first[once], runs[:, 0]), np.append(last[once], runs[:, 1] - SPAN)
                    anchor, own = np.append(anchor[once], runs[:, 0]), np.array([*map(len, places.values()), *none])
                    key, context = [key[i] for i in once] + none, [context[i] for i in once] + none
                n = len(key)
                rows["key"].extend(key)
                rows["context"].extend(context)
                rows["own"].append(own)
                rows["first"].append(first + begins[k])
                rows["last"].append(last + begins[k])
                rows["anchor"].append(anchor + begins[k])
                rows["t1"].append(np.full(n, t1[owners[k]]))
                rows["t2"].append(np.full(n, t2[owners[k]]))
        if rows["key"]:
            numbers = {c: np.concatenate(rows[c]) for c in ("t1", "t2", "first", "last", "anchor", "own")}
            yield arrow_rows(CONTEXTS, **numbers, key=_signed(rows["key"]), context=_signed(rows["context"]))


TEXTS = pa.schema([(c, pa.int64()) for c in ("key", "context", "many", "t1", "t2", "first", "last", "anchor")] + [("text", pa.binary())])
TEXTS_DDL = "key long, context long, many long, t1 long, t2 long, first long, last long, anchor long, text binary"
CUT = pa.schema([("hot", pa.bool_()), *TEXTS])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted context of a text."""
    for batch in pieces(batches, "text", 2 << 20):
        rows: dict[str, list] = {c: [] for c in CUT.names}
        for row in batch.to_pylist():
            for w in row["wanted"]:
                for c in ("hot", "key", "context", "many", "first", "last", "anchor"):
                    rows[c].append(w[c])
                rows["t1"].append(row["t1"])
                rows["t2"].append(row["t2"])
                rows["text"].append(row["text"][w["first"] : w["last"] + SPAN])
        yield arrow_rows(CUT, **rows)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in parts of STEP windows; the key is a hash of what all of a part's windows hold."""
    hashed = xxhash.xxh3_64_intdigest
    for batch in pieces(batches, "text", 1 << 17):
        rows: dict[str, list] = {c: [] for c in TEXTS.names}
        for row in zip(*[batch.column(c).to_pylist() for c in TEXTS.names], strict=True):
            off, text = row[7] - row[5], row[8]
            for j, core in cores(row):
                low, high = max(0, off - (j + 1) * STEP + 1), min(row[6] - row[5], off - j * STEP)
                part = text[low : high + SPAN]
                new = (hashed(core, j), hashed(part, off - low), *row[2:5], row[5] + low, row[5] + high, row[7], part)
                for c, v in zip(TEXTS.names, new, strict=True):
                    rows[c].append(v)
        rows |= {c: _signed(rows[c]) for c in ("key", "context")}
        yield arrow_rows(TEXTS, **rows)


FOUND = pa.schema([(c, pa.int64()) for c in ("t1", "t2", "start", "end", "many", "h1", "h2")])
FOUND_DDL = "t1 long, t2 long, start long, end long, many long, h1 long, h2 long"


def cores(row: tuple) -> Iterator[tuple[int, bytes]]:
    """Of a context (a row of TEXTS): j, and the 385 bytes in all its windows that begin j * STEP to (j + 1) * STEP - 1
    bytes before the anchor."""
    off, text, inner = row[7] - row[5], row[8], SPAN - STEP + 1
    for j in range((row[7] - row[6]) // STEP, off // STEP + 1):
        yield j, text[max(0, off - j * STEP) : off - j * STEP + inner]


def narrowed(group: list[tuple]) -> list[tuple]:
    """The parts of a key's contexts whose windows may repeat: where no other context of the key has the same core,
    none of the windows around it repeats."""
    ranges, seen = [], Counter()
    for row in group:
        own = [(j, xxhash.xxh3_64_intdigest(core)) for j, core in cores(row)]
        ranges.append(own)
        seen.update(own)
    out = []
    for row, own in zip(group, ranges, strict=True):
        off, text = row[7] - row[5], row[8]
        begin = end = None
        for j, h in reversed(own):  # from the first window on
            low, high = max(0, off - (j + 1) * STEP + 1), min(row[6] - row[5], off - j * STEP)
            if seen[j, h] > 1:
                begin = low if begin is None else begin
                end = high
            if begin is not None and (seen[j, h] < 2 or j == own[0][0]):
                out.append((*row[:5], row[5] + begin, row[5] + end, row[7], text[begin : end + SPAN]))
                begin = None
    return out


def repeats(rows: list[tuple]) -> Iterator[tuple]:
    """Of distinct contexts (.., many, t1, t2, first, last, anchor, text) in one shard: runs of repeated windows as
    (t1, t2, start, end), for contexts that occur once (of others it is known)."""
    t, stretches, at = [], [], 0
    for row in rows:
        t += [np.frombuffer(row[8], np.uint8).astype(np.int64) + 2, np.ones(1, np.int64)]
        stretches.append((at, at + row[6] - row[5] + 1))
        at += len(row[8]) + 1
    t = np.concatenate([*t, np.zeros(1, np.int64)])
    before, shared = common_prefixes(t, suffix_array(t, 258), stretches, SPAN)
    hit = shared >= SPAN
    hit[before[hit]] = True
    for row, (begin, end) in zip(rows, stretches, strict=True):
        if row[2] == 1:
            at = np.flatnonzero(np.diff(np.concatenate(([0], hit[begin:end].view(np.int8), [0]))))
            for x, y in at.reshape(-1, 2).tolist():
                yield row[3], row[4], row[5] + x, row[5] + y - 1 + SPAN


def windows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Every window of the contexts (rows of TEXTS) with 128 bits of its bytes, in batches of about ``WINDOWS``."""
    hashed = xxhash.xxh3_128_digest
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def batch() -> pa.RecordBatch:
        h, numbers = (np.concatenate(x) for x in zip(*held, strict=True))
        h = h.reshape(-1, 2)
        many, t1, t2, start = numbers.reshape(-1, 4).T
        return arrow_rows(FOUND, t1=t1, t2=t2, start=start, end=start + SPAN, many=many, h1=h[:, 0], h2=h[:, 1])

    size = 0
    for _, _, many, t1, t2, first, _, _, text in rows:
        n = len(text) - SPAN + 1
        numbers = np.empty((n, 4), np.int64)
        numbers[:, :3] = many, t1, t2
        numbers[:, 3] = first + np.arange(n)
        held.append((np.frombuffer(b"".join([hashed(text[p : p + SPAN]) for p in range(n)]), np.int64), numbers.ravel()))
        size += n
        if size >= WINDOWS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from windows(zip(*[batch.column(c).to_pylist() for c in TEXTS.names], strict=True))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (key, context): spans from shards of whole keys, or windows of a key that is too large."""
    shard, shard_size, group, group_size, key, context, spilling = [], 0, [], 0, None, None, False

    def spans() -> pa.RecordBatch:
        made = [*repeats(shard)] if shard else []
        t1, t2, start, end = zip(*made, strict=True) if made else ((), (), (), ())
        none = [None] * len(made)
        return arrow_rows(FOUND, t1=t1, t2=t2, start=start, end=end, many=none, h1=none, h2=none)

    def close_group() -> Iterator[pa.RecordBatch]:
        nonlocal group, group_size, shard_size, shard, spilling
        if spilling:
            yield from windows(group)
        elif len(group) > 1 and any(r[2] == 1 for r in group):
            parts = narrowed(group)
            shard += parts
            shard_size += sum(len(r[8]) for r in parts)
            if shard_size >= SHARD:
                yield spans()
                shard, shard_size = [], 0
        group, group_size, spilling = [], 0, False

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in TEXTS.names], strict=True):
            if row[0] != key:
                yield from close_group()
                key, context = row[0], None
            if row[1] == context:  # another copy of the same text
                continue
            context = row[1]
            group.append(row)
            group_size += len(row[8])
            if group_size > GROUP:
                spilling = True
                yield from windows(group)
                group, group_size = [], 0
    yield from close_group()
    yield spans()


def _of_hot_keys(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct contexts of hot keys (TEXTS): spans of parts that occur again as they are, and the windows of those
    that share what all their windows hold with other parts. No step brings a key together in one task."""
    parts = stage(cut.mapInArrow(_parts, TEXTS_DDL), "repeats-parts")
    slim = ["many", "t1", "t2", "first", "last", "anchor"]
    same = stage(parts.groupBy("key", "context").agg(F.sum("many").alias("n")), "repeats-same")
    twice = same.where("n > 1").select("key", "context")
    covered = parts.where("many = 1").select("key", "context", "t1", "t2", "first", "last").join(twice, ["key", "context"], "left_semi")
    shared = same.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    once = same.where("n = 1").select("key").distinct().join(shared, "key", "left_semi")
    open_parts = parts.join(once, "key", "left_semi").groupBy("key", "context").agg(F.sum("many").alias("n"), F.min(F.struct(*slim[1:])).alias("one"), F.first("text").alias("text"))
    rows = open_parts.select("key", "context", F.col("n").alias("many"), *[F.col(f"one.{c}").alias(c) for c in slim[1:]], "text")
    return covered, rows.mapInArrow(_windows, FOUND_DDL)


def spans(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, t1, t2, text: binary) to rows (t1, t2, start, end) that cover all repeated windows."""
    long = texts.where(F.length("text") >= SPAN).select("t1", "t2", "text")
    contexts = stage(long.mapInArrow(_contexts, CONTEXTS_DDL), "repeats-contexts")
    found = contexts.where("own > 0")
    # written first, so that the join reads two plain shuffles and Spark can split a key that very many texts share
    keys = stage(found.groupBy("key").agg(F.count("*").alias("rows"), (F.min("context") < F.max("context")).alias("mixed")).where("rows > 1"), "repeats-keys")
    is_hot = F.col("mixed") & (F.col("rows") > HOT)
    heavy = stage(keys.where(is_hot).orderBy(F.desc("rows"), "key").limit(HEAVY).select("key"), "repeats-hot")
    any_hot = not heavy.isEmpty()
    others = keys.join(F.broadcast(heavy), "key", "left_anti") if any_hot else keys
    again = found.join(others.select("key", "mixed", is_hot.alias("hot")), "key").select(*found.columns, "mixed", "hot")
    if any_hot:
        again = again.union(found.join(F.broadcast(heavy), "key").select(*found.columns, F.lit(True).alias("mixed"), F.lit(True).alias("hot")))
    again = stage(again, "repeats-again")
    covered = lambda df: df.select("t1", "t2", F.col("first").alias("start"), (F.col("last") + SPAN).alias("end"))
    mixed = again.where("mixed")
    distinct = stage(mixed.groupBy("key", "context", "hot").agg(F.sum("own").alias("many"), F.min(F.struct("t1", "t2", "first", "last", "anchor")).alias("one")), "repeats-distinct")
    often = mixed.where("own = 1").join(distinct.where("many > 1").select("key", "context"), ["key", "context"], "left_semi")
    # contexts that occur once, and those they may meet
    open_keys = distinct.where("many = 1 AND NOT hot").select("key").distinct()
    wanted = distinct.where("NOT hot").join(open_keys, "key", "left_semi").union(distinct.where("hot"))
    wanted = wanted.groupBy("one.t1", "one.t2").agg(F.collect_list(F.struct("hot", "key", "context", "many", "one.first", "one.last", "one.anchor")).alias("wanted"))
    named = texts.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id"))
    wanted = wanted.join(named, ["t1", "t2"]).withColumnsRenamed({"t1": "w1", "t2": "w2", "doc_id": "w_doc"})
    same = (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("w_doc"))
    cut = texts.join(wanted, same).select("t1", "t2", "text", "wanted").mapInArrow(_cut, f"hot boolean, {TEXTS_DDL}")
    cut = stage(cut, "repeats-cut")
    searched = stage(cut.where("NOT hot").drop("hot").repartition("key").sortWithinPartitions("key", "context").mapInArrow(_shards, FOUND_DDL), "repeats-found")
    counted = searched.where("h1 is not null")
    parts = [covered(contexts.where("own = 0")), covered(again.where("not mixed")), covered(often), searched.where("h1 is null").select("t1", "t2", "start", "end")]
    if any_hot:
        parts_covered, part_windows = _of_hot_keys(cut.where("hot").drop("hot"))
        counted = counted.union(stage(part_windows, "repeats-windows"))
        parts.append(covered(parts_covered))
    twice = counted.groupBy("h1", "h2").agg(F.sum("many").alias("n")).where("n > 1").select("h1", "h2")
    parts.append(counted.where("many = 1").join(twice, ["h1", "h2"], "left_semi").select("t1", "t2", "start", "end"))
    return reduce(DataFrame.union, parts)


def merged(spans_of: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans_of):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("kept", pa.binary())])


def _removed(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            rows: dict[str, list] = {c: [] for c in RESULT.names}
            for row in batch.to_pylist():
                text, kept, at = row["text"], [], 0
                runs = merged([(s["start"], s["end"]) for s in row["spans"] or []])
                for start, end in runs:
                    kept.append(text[at:start])
                    at = end
                rest = b"".join([*kept, text[at:]])
                for c, v in zip(RESULT.names, (row["doc_id"], len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore"), rest if keep_bytes else None), strict=True):
                    rows[c].append(v)
            yield arrow_rows(RESULT, **rows)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, and ``kept`` (bytes) if asked for.

    ``text`` is what remains, without the bytes of characters that a removal cut apart; kept_sha256 is of all bytes
    that remain, which ``kept`` holds.
    Null texts are empty. Copies of a text are places of their own: of 400 bytes or more, all of them goes. Null ids
    and repeated rows each keep their row. Other columns are ignored; an empty table gives no rows. Texts and contexts
    are told apart by 128 bits of hashes; windows by their bytes, in keys of over ``GROUP`` bytes by 128 bits.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    # copies of a text give the same spans: once each
    found = stage(spans(texts).distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "repeats-spans")
    joined = texts.join(found, ["t1", "t2"], "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(_removed(keep_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, kept binary")
    return out if keep_bytes else out.drop("kept")
