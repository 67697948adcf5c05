"""Approximate nearest neighbours: a vantage-point tree per shard, pruned by the triangle inequality.

A subtree whose distances to the vantage point lie in [low, high] can't hold anything nearer to a query at distance d
than max(d - high, low - d). It is left out once ``relax`` times that gap passes the query's kth distance so far:
factor 1 is the exact search, larger factors leave out more. Queries go down a tree together, nearer side first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import blocks

LEAF, RELAX, NEAREST = 128, 1.1, 10


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, by differences."""
    out = np.empty((len(a), len(b)))
    for k in range(0, len(a), 64):
        d = a[k : k + 64, None, :] - b[None, :, :]
        out[k : k + 64] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple]]:
    """The points' order and the nodes: (begin, end) of a leaf, or (vantage, high, low, high of the rest, inner, outer)."""
    order, nodes = np.arange(len(points)), []

    def grow(begin: int, end: int) -> int:
        at = len(nodes)
        nodes.append(())
        if end - begin <= leaf:
            nodes[at] = (begin, end)
            return at
        own = order[begin:end]
        some = points[own[:: max(1, len(own) // 16)]]
        spread = distances(some, points[own[:: max(1, len(own) // 64)]]).var(axis=1)
        vantage = some[int(spread.argmax())]
        d = distances(vantage[None], points[own])[0]
        by = np.argsort(d, kind="stable")
        order[begin:end], d, half = own[by], d[by], len(own) // 2
        nodes[at] = (vantage, d[half - 1], d[half], d[-1], grow(begin, begin + half), grow(begin + half, end))
        return at

    if len(points):
        grow(0, len(points))
    return order, nodes


def _arrays(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    return table.column("vec_id").to_numpy(), [np.asarray(v.values, dtype=np.float64) for v in table.column("vector").combine_chunks()] if table.num_rows else []


def by_width(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and points, in order of id, by the number of components: only vectors of one width have a distance."""
    ids, vectors = _arrays(table)
    widths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    out = {}
    for w in np.unique(widths).tolist():
        at = np.nonzero(widths == w)[0]
        at = at[np.argsort(ids[at], kind="stable")]
        out[w] = (ids[at], np.stack([vectors[k] for k in at]))
    return out


def build(table: pa.Table) -> dict:
    out = {}
    for w, (ids, points) in by_width(table).items():
        order, nodes = tree(points)
        out[w] = (ids[order], points[order], nodes)
    return out


def knn(index: tuple, asked: tuple, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
    """For each query the k nearest ids and distances found (id -1 where there are fewer); ties to smaller ids."""
    (ids, points, nodes), (names, queries) = index, asked
    best_d, best_id = np.full((len(queries), k), np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)

    def visit(at: int, q: np.ndarray) -> None:
        if not len(q):
            return
        node = nodes[at]
        if len(node) == 2:
            begin, end = node
            d = distances(queries[q], points[begin:end])
            d[ids[None, begin:end] == names[q, None]] = np.inf
            better = d.min(axis=1) <= best_d[q, -1]  # equal ones may have smaller ids
            q, d = q[better], d[better]
            all_d = np.concatenate((best_d[q], d), axis=1)
            all_id = np.concatenate((best_id[q], np.broadcast_to(ids[begin:end], d.shape)), axis=1)
            by = np.lexsort((all_id, all_d), axis=1)[:, :k]
            best_d[q], best_id[q] = np.take_along_axis(all_d, by, 1), np.take_along_axis(all_id, by, 1)
            return
        vantage, high, low, top, inner, outer = node
        d = distances(queries[q], vantage[None])[:, 0]
        near = d <= (high + low) / 2
        gap_in, gap_out = np.maximum(d - high, 0), np.maximum(np.maximum(low - d, d - top), 0)
        may = lambda gap: relax * gap <= best_d[q, -1] * (1 + 1e-12)
        visit(inner, q[near & may(gap_in)])
        visit(outer, q[~near & may(gap_out)])
        visit(inner, q[~near & may(gap_in)])
        visit(outer, q[near & may(gap_out)])

    if nodes:
        visit(0, np.arange(len(queries)))
    best_id[np.isinf(best_d)] = -1
    return best_id, best_d


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, relax: float = RELAX, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = blocks.SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found among all ``vectors`` but its own id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; vectors of
    different widths have no distance. Fewer candidates than ``k`` give fewer rows, none gives none. Repeated rows
    return as often as they occur. Other columns are ignored.
    """

    def find(index: dict, asked: dict) -> tuple[list, list, list]:
        out: tuple[list, list, list] = [], [], []
        for w, (names, points) in asked.items():
            if w in index:
                got, d = knn(index[w], (names, points), k, relax)
                row, col = np.nonzero(~np.isinf(d))
                for to, new in zip(out, (names[row], got[row, col], d[row, col]), strict=True):
                    to.extend(new.tolist())
        return out

    rows, asked = (blocks.usable(t, id_col, vec_col).where("vec_id is not null") for t in (vectors, queries))
    return blocks.search(rows, asked, build, by_width, find, k, "double", shard=shard)
