"""Hard negatives: by inner product the rows just below an anchor's positives, found with a table of pivot distances.

A row x of a shard gets one more component, sqrt(M - |x|^2) with M the shard's largest squared length, and an anchor q
gets a 0: then |q - x|^2 = |q|^2 + M - 2 (q x), and an inner product is a Euclidean distance. The shard stores each
row's distances to a few pivots. By the triangle inequality the anchor's own distances to them bracket its distance to
each row, hence each score. Rows lie in tiles of like distances, so that whole tiles fall out first; rows whose bracket
can't hold a wanted score fall out next; the scores of the rest are computed, as exact integers.

Shards are dealt by place, so that no id, label or vector can fill one. An index meets all blocks of anchors in one
pass (``blocks.meet``); the best of each shard meet in windows whose limits Spark applies before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import blocks
from riskloom.llm.common import ship, stage

PIVOTS, TILE, POSITIVES, NEGATIVES, SCALE, LOW = 8, 128, 5, 5, 256, 80
#: Squared lengths from here on have no score that is sure to fit a long.
LONGEST = 2.0**62
#: Up to this bound sums of products are exact in double precision.
EXACT = 2.0**53
NO_ID = np.iinfo(np.int64).max


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, label, vector (doubles, floor of ``scale`` times each component)."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate(v, F.lit(0.0), lambda a, x: a + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1))
    ok = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(fine, F.lit(False)) & (length < LONGEST)
    label = F.col(label_col).cast("long")
    label = F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label)
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("vector"))


def _lists(table: pa.Table, column: str) -> list[np.ndarray]:
    return [np.asarray(v.values, dtype=np.float64) for v in table.column(column).combine_chunks()] if table.num_rows else []


def _widths(vectors: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    return [(w, np.nonzero(sizes == w)[0]) for w in np.unique(sizes).tolist()]


def far(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances, by the expanded square; ``slack`` covers what that loses."""
    d = (points * points).sum(1)[:, None] + (others * others).sum(1)[None] - 2 * (points @ others.T)
    return np.sqrt(np.maximum(d, 0))


def slack(top: float) -> float:
    """More than the error of a distance whose squared lengths are at most ``top``."""
    return 1e-6 * np.sqrt(top + 1) + 1e-6


def table_of(points: np.ndarray, pivots: int = PIVOTS, tile: int = TILE) -> dict:
    """The pivot table of one shard: an order of its rows, their pivot distances, and each tile's least and greatest."""
    squares = (points * points).sum(axis=1)
    top = float(squares.max())
    lifted = np.concatenate((points, np.sqrt(np.maximum(top - squares, 0))[:, None]), axis=1)
    chosen = [int(squares.argmax())]
    near = far(lifted, lifted[chosen])[:, 0]
    for _ in range(min(pivots, len(points)) - 1):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, far(lifted, lifted[chosen[-1:]])[:, 0])
    centres = lifted[chosen]
    d = far(lifted, centres)
    own = d.argmin(axis=1)
    order = np.lexsort((d[np.arange(len(d)), own], own))
    d = d[order]
    begins = np.arange(0, len(d), tile)
    return {"order": order, "points": points[order], "d": d, "pivots": centres, "top": top, "begins": begins, "low": np.minimum.reduceat(d, begins), "high": np.maximum.reduceat(d, begins)}


def build(table: pa.Table) -> dict:
    """A pivot table for each width of vector."""
    ids, labels, vectors, out = table.column("vec_id").to_numpy(), table.column("label").to_numpy(), _lists(table, "vector"), {}
    for w, at in _widths(vectors):
        made = table_of(np.stack([vectors[k] for k in at]))
        order = at[made.pop("order")]
        out[w] = made | {"ids": ids[order], "labels": labels[order]}
    return out


def prepare(table: pa.Table) -> dict:
    """Anchors by width: their key, id, label and vector, and the bounds of the scores asked for, if there are any."""
    vectors, out = _lists(table, "vector"), {}
    asked = "bounds" in table.column_names
    for w, at in _widths(vectors):
        out[w] = {c: table.column(c).to_numpy()[at] for c in ("anchor", "vec_id", "label")} | {"vector": np.stack([vectors[k] for k in at])}
        if asked:
            lists = [table.column("bounds")[int(k)].as_py() for k in at]
            out[w]["of"] = np.repeat(np.arange(len(at)), [len(x) for x in lists])
            out[w]["bounds"] = np.array([b for x in lists for b in x], np.int64)
            out[w]["place"] = np.array([k for x in lists for k in range(len(x))], np.int64)
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as integers: in double precision where every sum is exact there, else in longs."""
    if len(a) and len(b) and float((a * a).sum(1).max()) * float((b * b).sum(1).max()) < EXACT**2:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def find(index: dict, asked: dict, k: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """The ``k`` best ids and scores of each ask, best first (id NO_ID where there are fewer), and counts of the work.

    Without bounds an ask is an anchor and wants the rows of its label, but its own id. With bounds it wants the rows of
    other labels whose score s has LOW bound <= 100 s <= 100 bound.
    """
    bounded = "bounds" in asked
    of = asked["of"] if bounded else np.arange(len(asked["anchor"]))
    q, ids, labels = asked["vector"], index["ids"], index["labels"]
    best = np.full((len(of), k), np.iinfo(np.int64).min)
    best_id = np.full((len(of), k), NO_ID)
    squares = (q * q).sum(axis=1)
    loose = slack(index["top"] + float(squares.max(initial=0)))
    to = far(np.concatenate((q, np.zeros((len(q), 1))), axis=1), index["pivots"])
    half = (squares + index["top"]) / 2
    # what a distance of at least / at most so much says of the score
    most = lambda d, rows: half[rows, None] - np.maximum(d - loose, 0) ** 2 / 2 + loose
    least = lambda d, rows: half[rows, None] - (d + loose) ** 2 / 2 - loose
    every = np.arange(len(q))
    below = np.maximum(index["low"][None] - to[:, None], to[:, None] - index["high"][None]).max(axis=2)
    above = (index["high"][None] + to[:, None]).min(axis=2)
    tile_most, tile_least = most(np.maximum(below, 0), every), least(above, every)
    top = asked["bounds"] if bounded else None
    bottom = -(-LOW * top // 100) if bounded else None
    work = {"pairs": len(q) * len(ids), "bracketed": 0, "exact": 0}
    for t in np.argsort(-tile_most.max(axis=0), kind="stable").tolist() if len(q) else ():
        floor = np.maximum(best[:, -1], bottom) if bounded else best[:, -1]
        live = tile_most[of, t] >= floor
        if bounded:
            live &= (tile_least[of, t] <= top) & (bottom <= top)
        asks = np.nonzero(live)[0]
        if not len(asks):
            continue
        rows = np.unique(of[asks])
        at = np.searchsorted(rows, of[asks])
        begin, end = index["begins"][t], min(index["begins"][t] + TILE, len(ids))
        d = index["d"][begin:end]
        gap = np.abs(to[rows, 0, None] - d[None, :, 0])
        reach = to[rows, 0, None] + d[None, :, 0]
        for j in range(1, d.shape[1]):
            np.maximum(gap, np.abs(to[rows, j, None] - d[None, :, j]), out=gap)
            np.minimum(reach, to[rows, j, None] + d[None, :, j], out=reach)
        same = asked["label"][rows, None] == labels[None, begin:end]
        wanted = ~same if bounded else same & (asked["vec_id"][rows, None] != ids[None, begin:end])
        hope = most(gap, rows)
        may = wanted[at] & (hope[at] >= floor[asks, None])
        if bounded:
            may &= least(reach, rows)[at] <= top[asks, None]
        work["bracketed"] += len(rows) * (end - begin)
        keep = may.any(axis=1)
        asks, at, may = asks[keep], at[keep], may[keep]
        cols = np.nonzero(may.any(axis=0))[0]
        if not len(cols):
            continue
        rows, at = np.unique(rows[at], return_inverse=True)
        scores = exact(q[rows], index["points"][begin:end][cols])
        work["exact"] += scores.size
        s = scores[at]
        good = may[:, cols] & (s >= floor[asks, None])
        if bounded:
            good &= s <= top[asks, None]
        keep = good.any(axis=1)
        asks, s, good = asks[keep], s[keep], good[keep]
        if not len(asks):
            continue
        all_s = np.concatenate((best[asks], np.where(good, s, np.iinfo(np.int64).min)), axis=1)
        all_id = np.concatenate((best_id[asks], np.where(good, ids[begin:end][cols][None], NO_ID)), axis=1)
        by = np.lexsort((all_id, ~all_s), axis=1)[:, :k]  # ~s falls as s grows, and fits wherever s does
        best[asks], best_id[asks] = np.take_along_axis(all_s, by, 1), np.take_along_axis(all_id, by, 1)
    return best_id, best, work


def _best(index: DataFrame, shards: int, asked: DataFrame, k: int) -> DataFrame:
    """anchor, place, row_id, score: of each ask the ``k`` best of every shard."""

    def run(tables: dict, questions: dict) -> pa.RecordBatch:
        out: dict[str, list] = {"anchor": [], "place": [], "row_id": [], "score": []}
        for w, ask in questions.items():
            if w in tables:
                got, scores, _ = find(tables[w], ask, k)
                row, col = np.nonzero(got != NO_ID)
                anchor = ask["of"][row] if "of" in ask else row
                out["anchor"].extend(ask["anchor"][anchor].tolist())
                out["place"].extend((ask["place"][row] if "of" in ask else np.zeros(len(row), np.int64)).tolist())
                out["row_id"].extend(got[row, col].tolist())
                out["score"].extend(scores[row, col].tolist())
        return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    found = blocks.meet(index, asked, shards, run, "anchor long, place long, row_id long, score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, anchors: str = "vec_id % 100 = 0", id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shard: int = blocks.SHARD) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` chooses among the usable rows (vec_id, label, vector). Rows with a null id or label, a null vector, or
    a null or non-finite component take no part; neither do vectors so long that a score may not fit a long. Zero and
    empty vectors score 0; vectors of different widths have no score. Ties go to the smaller id. A repeated row is as
    many candidates; a repeated anchor is one, rows that share an id but differ are anchors each. Anchors without a
    positive, positives below 0 and those without a negative give no row; an empty table gives none. Other columns
    are ignored.
    """
    ship(vectors.sparkSession)
    rows = usable(vectors, id_col, vec_col, label_col)
    index, shards = blocks.packed(rows, "shard", shard, build, "tree")
    own = stage(rows.where(anchors).distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    asked, _ = blocks.packed(own, "block", blocks.BLOCK, prepare, "asked")
    found = stage(_best(index, shards, asked, positives).select("anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # at most ``positives`` an anchor, in order of rank
    bounds = found.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("bounds"))
    again, _ = blocks.packed(stage(own.join(bounds, "anchor"), "bounded"), "block", blocks.BLOCK, prepare, "asked")
    best = _best(index, shards, again, negatives).select("anchor", "place", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.join(own.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return best.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
