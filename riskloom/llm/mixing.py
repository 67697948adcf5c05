"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded block selection.

Everything is DataFrame work. Documents of a source lie in seeded order on tapes (shards) of about ``SHARD`` words; a
tape is cut into blocks of ``BLOCK`` words. The mix's blocks go to sources by highest quotients target / (2 s + 1), a
source's blocks to batches of its shards and then to the shards likewise, and a shard's quota picks blocks by a seeded
permutation, whole passes first.
Only quotients near the divisor are listed: a divisor over the true one gives seats that are certain, one below it
gives seats that suffice, and at most two per party lie between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import join_small, stage, unused

WEIGHTS, TOTAL, CEILING = (3, 1, 2), 1.5, 2.0
BLOCK, SHARD, BATCH, SEED = 64, 65_536, 4096, 17
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words of the text; null: 0)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, ceiling: float = CEILING) -> DataFrame:
    """One row per source: number (by code point, null last), source_size, target.

    Weights repeat over the sources; ``total`` times all words are shared by weight; a target stops at ``ceiling``
    times its source's size and the excess is shared again by weight. Sources sorted by ceiling per weight stop in
    that order, so the level at which the rest share is found with running sums. The table has a row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    number = F.row_number().over(order) - 1
    per = per.withColumn("number", number).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("number", F.lit(len(weights))) + 1))
    cap = F.col("source_size") * ceiling
    by = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("cap", cap)
    level = (F.sum("source_size").over(every) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    stops = F.col("cap") / F.col("weight") <= F.col("level")
    per = per.withColumn("share", F.first(F.when(~stops, F.col("level")), ignorenulls=True).over(every))
    target = F.when(F.col("share").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("share") * F.col("weight")))
    return per.select("source", "number", "source_size", target.alias("target"))


def apportion(parties: DataFrame, within: list[str], seats: str, claim: str, ties: list[str], most: str) -> DataFrame:
    """``parties`` plus quota: ``seats`` (of the group ``within``) by highest quotients claim / (2 s + 1).

    Ties go to the lesser ``ties``. No quota passes ``most``. Claims of null or 0 get none. Empty tables give none.
    """
    group = Window.partitionBy(*within)
    n, all_claims, house = F.count(F.when(F.col(claim) > 0, 1)).over(group), F.sum(claim).over(group), F.col(seats)
    rounded = lambda d: F.floor(F.col(claim) / d + 0.5).cast("long")
    over = F.when(house * 2 > F.col("_n"), F.col("_all") / (house - F.col("_n") / 2.0))
    under = F.col("_all") / (house + F.col("_n") / 2.0 + 1)
    x = parties.withColumn("_n", n).withColumn("_all", all_claims)
    active = (F.col(claim) > 0) & (house > 0)
    sure = F.when(active & over.isNotNull(), F.greatest(rounded(over * (1 + 1e-12)) - 1, F.lit(0))).otherwise(F.lit(0))
    some = F.when(active, rounded(under) + 1).otherwise(F.lit(0))
    x = x.withColumn("_sure", sure.cast("long")).withColumn("_some", F.greatest(some.cast("long"), F.col("_sure")))
    x = x.withColumn("_left", house - F.sum("_sure").over(group))
    quotients = x.where("_some > _sure").select(*within, *[c for c in ties if c not in within], "_left", F.explode(F.sequence("_sure", F.col("_some") - 1)).alias("_s"), F.col(claim).alias("_c"))
    best = Window.partitionBy(*within).orderBy((F.col("_c") / (2 * F.col("_s") + 1)).desc(), *ties, "_s")
    won = quotients.withColumn("_rank", F.row_number().over(best)).where("_rank <= _left").groupBy(*[F.col(c) for c in dict.fromkeys([*within, *ties])]).agg(F.count("*").alias("_won"))
    keys = [*dict.fromkeys([*within, *ties])]
    joined = x.join(won, keys, "left")
    quota = F.least(F.col("_sure") + F.coalesce("_won", F.lit(0)), F.col(most)).cast("long")
    return joined.withColumn("quota", quota).drop("_n", "_all", "_sure", "_some", "_left", "_won")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, ceiling: float = CEILING, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, passes, spans.

    ``passes`` counts whole copies in the mix, ``spans`` (start, end: words from 0) the blocks taken once more; taken
    = passes * size + words of the spans, at most 2 * size. Null text has size 0; null source is a source of its own,
    last; null ids are allowed, repeated rows each count. Other columns are ignored. Reruns agree: the order is a hash
    of seed, id and size. An empty table gives no rows.
    """
    sized = stage(sizes(docs), "mix-sizes")
    goal = stage(targets(sized, weights, total, ceiling).withColumn("shards", F.greatest(F.ceil(F.col("source_size") / F.lit(shard)), F.lit(1))), "mix-targets")
    sources = goal.count()
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    named = sized.withColumn("_null", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
    slim = goal.select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source"), "number", "source_size", "target", "shards")
    placed = join_small(named, slim, ["_null", "_source"], "inner", sources).withColumn("order", key)
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), F.col("shards")))
    tape = Window.partitionBy("number", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = stage(placed.select("doc_id", "source", "size", "number", "shard", "source_size", "target", F.coalesce(F.sum("size").over(tape), F.lit(0)).cast("long").alias("begin")), "mix-tapes")

    seats = goal.select("number", "source_size", "target", F.lit(1).alias("mix")).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy("mix")) / block).cast("long"))
    seats = seats.withColumn("most", F.ceil(F.col("source_size") * ceiling / block) + 1)
    per_source = apportion(seats, ["mix"], "seats", "target", ["number"], "most").select("number", F.col("quota").alias("source_quota"))
    shards = placed.groupBy("number", "shard").agg(F.sum("size").cast("double").alias("words"))
    shards = shards.withColumn("blocks", F.ceil(F.col("words") / block)).withColumn("most", F.floor(F.col("blocks") * ceiling)).withColumn("batch", F.expr(f"shard div {BATCH}"))
    shards = stage(shards, "mix-shards")
    # a source's quota goes to batches of shards, a batch's to its shards: no window holds all shards of a source
    batches = shards.groupBy("number", "batch").agg(F.sum("words").alias("words"), F.sum("most").alias("most")).join(per_source, "number")
    per_batch = apportion(batches, ["number"], "source_quota", "words", ["batch"], "most").select("number", "batch", F.col("quota").alias("batch_quota"))
    per_shard = stage(apportion(shards.join(per_batch, ["number", "batch"]), ["number", "batch"], "batch_quota", "words", ["shard"], "most").select("number", "shard", "blocks", "quota"), "mix-quotas")
    per_shard = per_shard.withColumn("passes", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(F.lit(0))).withColumn("extra", F.col("quota") - F.col("passes") * F.col("blocks"))
    chosen = per_shard.where("extra > 0").select("number", "shard", "extra", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    lot = Window.partitionBy("number", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "number", "shard", "block"), "block")
    chosen = chosen.withColumn("_lot", F.row_number().over(lot)).where("_lot <= extra").groupBy("number", "shard").agg(F.collect_list("block").alias("picked"))
    # a shard has about `shard` words, so shard / block picks at most, unless one document is longer
    state = per_shard.select("number", "shard", F.col("passes").cast("int").alias("passes")).join(chosen.hint("merge"), ["number", "shard"], "left")
    out = placed.join(state.hint("merge"), ["number", "shard"])  # the picks outgrow what the planner guesses: no broadcast
    last = (F.col("begin") + F.col("size") - 1) / block
    mine = F.array_sort(F.filter(F.coalesce("picked", F.array().cast("array<long>")), lambda b: (b >= F.floor(F.col("begin") / block)) & (b <= F.floor(last)) & (F.col("size") > 0)))
    spans = F.transform(mine, lambda b: F.struct(F.greatest(b * block - F.col("begin"), F.lit(0)).alias("start"), F.least((b + 1) * block - F.col("begin"), F.col("size")).alias("end")))
    out = out.withColumn("spans", spans)
    taken = F.col("passes") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "passes", "spans")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document ``passes`` times, and once its spans' words."""
    own = unused(docs, "mix")
    plan = mix(docs, **how).select(*[F.col(c).alias(f"{own}_{c}") for c in ("doc_id", "source", "size", "passes", "spans")])
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    keys = [f"{own}_doc_id", f"{own}_source", f"{own}_size"]
    # the n-th row of an id, source and size meets the n-th plan of them: only repeated rows have a second
    nth = lambda df, *by: df.withColumn(f"{own}_nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(1))))
    left = docs.withColumn(f"{own}_words", words)
    repeated = not plan.groupBy(*keys).count().where("count > 1").isEmpty()
    if repeated:
        left = nth(left, "doc_id", "source", f"{own}_words").withColumnRenamed(f"{own}_nth", f"{own}_row")
        plan = nth(plan, *keys)
    on = left["doc_id"].eqNullSafe(plan[keys[0]]) & left["source"].eqNullSafe(plan[keys[1]]) & (left[f"{own}_words"] == plan[keys[2]])
    both = left.join(plan, on & (left[f"{own}_row"] == plan[f"{own}_nth"]) if repeated else on)
    tokens, spans, passes = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1), F.col(f"{own}_spans"), F.col(f"{own}_passes")
    cut = F.transform(spans, lambda s: F.slice(F.col(f"{own}_tokens"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    both = both.withColumn(f"{own}_tokens", F.when(F.size(spans) > 0, tokens))
    part = F.when(F.size(spans) > 0, F.array(F.array_join(F.flatten(cut), "")))
    copies = F.concat(F.array_repeat(F.col("text"), passes), F.coalesce(part, F.array().cast("array<string>")))
    rows = both.withColumn("text", F.explode(copies))
    made = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows
    return made.select(docs.columns)
