"""Exact top-k by Hamming distance: incremental multi-index hashing of 64-bit codes.

A code is cut into 4 segments of 16 bits, each with its own table. A search looks at all segment values within radius
0, then 1, ...: after radius r every code within 4 (r + 1) - 1 has been met, as some segment of it differs in at most
r bits; after segment j of radius r the bound is 4 r + j. It ends when the kth verified distance is within the bound.
Each shard is searched so; the best of the shards are the best of all.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import blocks

SEGMENTS, WIDTH, NEAREST, SHARD = 4, 16, 10, 65_536


@lru_cache(maxsize=None)
def flips(radius: int) -> np.ndarray:
    """All 16-bit masks with ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)], np.int64)


def segment(codes: np.ndarray, j: int) -> np.ndarray:
    return ((codes >> np.uint64(WIDTH * j)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)


def build(table: pa.Table) -> tuple:
    """Distinct codes, their ids in order (begins by code), and for each segment the codes by value (begins by value)."""
    ids, codes = table.column("vec_id").to_numpy(), table.column("code").to_numpy().view(np.uint64)
    by = np.lexsort((ids, codes))
    distinct, begins = np.unique(codes[by], return_index=True)
    tables = []
    for j in range(SEGMENTS):
        value = segment(distinct, j)
        order = np.argsort(value, kind="stable")
        tables.append((order, np.searchsorted(value[order], np.arange((1 << WIDTH) + 1))))
    return distinct, ids[by], np.append(begins, len(ids)), tables


def prepare(table: pa.Table) -> tuple:
    return table.column("vec_id").to_numpy(), table.column("code").to_numpy().view(np.uint64)


def top(index: tuple, name: int, code: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest ids but ``name`` and their distances, ties to smaller ids."""
    codes, ids, begins, tables = index
    own = [segment(np.array([code], np.uint64), j) for j in range(SEGMENTS)]
    need = k + int((ids == name).sum())
    seen, found, dist = np.zeros(len(codes), bool), [], []
    held = np.zeros(WIDTH * SEGMENTS + 1, np.int64)
    for radius, j in ((r, j) for r in range(WIDTH + 1) for j in range(SEGMENTS)):
        order, starts = tables[j]
        values = own[j] ^ flips(radius)
        low, n = starts[values], starts[values + 1] - starts[values]
        hit = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        hit = hit[~seen[hit]]
        seen[hit] = True
        d = np.bitwise_count(codes[hit] ^ code).astype(np.int64)
        found.append(hit)
        dist.append(d)
        np.add.at(held, d, begins[hit + 1] - begins[hit])
        if held[: SEGMENTS * radius + j + 1].sum() >= need:
            break
    hit, d = np.concatenate(found), np.concatenate(dist)
    last = int(np.searchsorted(np.cumsum(held), need))
    near = [(own_ids[own_ids != name][:k], x) for h, x in zip(hit[d <= last], d[d <= last], strict=True) for own_ids in [ids[begins[h] : begins[h + 1]]]]
    all_ids = np.concatenate([np.empty(0, np.int64), *[g for g, _ in near]])
    all_d = np.concatenate([np.empty(0, np.int64), *[np.full(len(g), x, np.int64) for g, x in near]])
    by = np.lexsort((all_ids, all_d))[:k]
    return all_ids[by], all_d[by]


def nearest_codes(rows: DataFrame, queries: DataFrame, k: int = NEAREST, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, distance: each query's ``k`` nearest of ``rows`` (vec_id, code: long), but its own id.

    Exact; ties to smaller ids. Null ids and codes take no part. Fewer candidates give fewer rows, repeated rows
    return as often as they occur, other columns are ignored.
    """

    def find(index: tuple, asked: tuple) -> tuple[list, list, list]:
        out: tuple[list, list, list] = [], [], []
        for name, code in zip(*asked, strict=True):
            ids, d = top(index, int(name), code, k)
            out[0].extend([int(name)] * len(ids))
            out[1].extend(ids.tolist())
            out[2].extend(d.tolist())
        return out

    slim = [t.select(F.col("vec_id").cast("long"), F.col("code").cast("long")).dropna() for t in (rows, queries)]
    return blocks.search(*slim, build, prepare, find, k, "int", shard=shard).withColumnRenamed("score", "distance")


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and code: bit i is 1 if component i is positive (64 at most). Unusable vectors are left out."""
    v = blocks.usable(vectors, id_col, vec_col)
    bits = F.transform("vector", lambda x, i: F.when((x > 0) & (i < 64), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return v.select("vec_id", F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)).alias("code"))
