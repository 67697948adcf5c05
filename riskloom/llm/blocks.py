"""A stated query set against all rows, in blocks: shard indexes of bounded size, query blocks of bounded size.

Rows are dealt to shards of about ``SHARD`` rows by their place in the scan, so no key can fill one. Each shard makes
one index row; queries make blocks of about ``BLOCK``. Each (shard, block) is one small search; the best of each query
meet in a window whose limit Spark applies before the shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import ship, stage

SHARD, BLOCK = 8192, 256
Build = Callable[[pa.Table], object]
Search = Callable[[object, object], tuple[list, list, list]]


def packed(df: DataFrame, group: str, most: int, build: Build, name: str) -> tuple[DataFrame, int]:
    """One row per group of about ``most`` rows: its number and what ``build`` makes of it."""
    rows = df.count()
    groups = max(1, -(-rows // most))

    def make(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({group: pa.array([key[0].as_py()], pa.int64()), name: pa.array([pickle.dumps(build(table), protocol=5)], pa.binary())})

    dealt = df.withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return stage(dealt.groupBy(group).applyInArrow(make, f"{group} long, {name} binary"), f"blocks-{name}"), groups


def meet(index: DataFrame, asked: DataFrame, shards: int, run: Callable[[object, object], pa.RecordBatch], schema: str) -> DataFrame:
    """``run(tree, questions)`` for every shard of ``index`` (shard, tree) and every block of ``asked`` (block, asked).

    A shard's tree moves once: in its partition it comes first, and the blocks stream past it. Only what is asked is
    copied, once a shard. A task holds one tree and one batch of blocks.
    """
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    trees = index.select("shard", F.lit(-1).cast("long").alias("block"), F.col("tree").alias("held"))
    both = trees.unionByName(asked.select(every.alias("shard"), "block", F.col("asked").alias("held")))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for batch in batches:
            for shard, block, held in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), batch.column("held"), strict=True):
                if block < 0:
                    now, tree = shard, pickle.loads(held.as_buffer())
                elif shard == now:
                    yield run(tree, pickle.loads(held.as_buffer()))

    return both.repartition(shards, "shard").sortWithinPartitions("shard", "block").mapInArrow(stream, schema)


def search(rows: DataFrame, queries: DataFrame, build: Build, prepare: Build, find: Search, k: int, score: str, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the ``k`` least scores that ``find`` gives, ties to smaller ids."""
    ship(rows.sparkSession)
    index, shards = packed(rows, "shard", shard, build, "tree")
    asked, _ = packed(queries, "block", block, prepare, "asked")
    kind, arrow = ("double", pa.float64()) if score == "double" else ("int", pa.int32())

    def run(tree: object, questions: object) -> pa.RecordBatch:
        names, ids, scores = find(tree, questions)
        return pa.RecordBatch.from_pydict({"query_id": pa.array(names, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, arrow)})

    found = meet(index, asked, shards, run, f"query_id long, vec_id long, score {kind}")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Id and vector as doubles, without vectors that are null, empty, zero or hold null or non-finite components."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
