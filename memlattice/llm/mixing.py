"""Mixing sources to target weights, repeating small sources at most a capped number of times.

Method: Sainte-Lague apportionment. The total is cut into blocks of equal tokens; blocks go to the sources by the highest
quotients share / (2 q + 1) among those whose cap of repeats is not reached. The blocks of a source are spread over its
shards by the same rule, so every shard gets an integer quota, and takes that many of its blocks in seeded order. As
documents are drawn whole, a few more or fewer of each source then make up for what those at the edges of shards are off.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import clean_id
from ..plans.settle import broadcast_if_small, discard, settle
from .encoding import VOCABULARY, token_counts

#: Tokens per block.
BLOCK_TOKENS = 256
#: Blocks per shard of a source.
SHARD_BLOCKS = 2_048
#: Buckets of the seeded order within which documents are summed; a bucket holds about this many documents.
BUCKET_DOCUMENTS = 20_000
#: Documents of each size (by powers of two) that are looked at when a source's quota is made up.
SPARE = 8
#: Apportionment runs over one row per source on the driver; with more sources than this the call is refused.
MOST_SOURCES = 100_000


def source_name(c: Column | str) -> Column:
    """One spelling per source: lower case, without outer blanks, words joined by '-'."""
    return F.regexp_replace(F.lower(clean_id(c)), r"[\s_\-]+", "-")


def apportion(shares: list[float], caps: list[int | None], blocks: int) -> list[int]:
    """Sainte-Lague: the blocks of each party by highest quotients, none beyond its cap. Ties go to the earlier party.

    Parties without a positive share get nothing. If all caps are reached, fewer blocks are given out.
    """
    total = sum(s for s in shares if s > 0)
    if not total or blocks <= 0:
        return [0] * len(shares)
    weights = [max(s, 0.0) / total for s in shares]
    limits = [blocks if c is None else min(c, blocks) for c in caps]
    given = lambda d: [min(limit, math.floor(w * d + 0.5)) for w, limit in zip(weights, limits)]
    if sum(limit for w, limit in zip(weights, limits) if w > 0) <= blocks:
        return [limit if w > 0 else 0 for w, limit in zip(weights, limits)]
    low, high = 0.0, float(blocks)
    while sum(given(high)) < blocks:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(given(middle)) <= blocks else (low, middle)
    quotas = given(low)
    heap = [(-w / (2 * q + 1), i) for i, (w, q, limit) in enumerate(zip(weights, quotas, limits)) if w > 0 and q < limit]
    heapq.heapify(heap)
    for _ in range(blocks - sum(quotas)):
        _, i = heapq.heappop(heap)
        quotas[i] += 1
        if quotas[i] < limits[i]:
            heapq.heappush(heap, (-weights[i] / (2 * quotas[i] + 1), i))
    return quotas


def _placed(sized: DataFrame, seed: int) -> DataFrame:
    """``sized`` with start: the tokens of the documents of the same source before it, in seeded order.

    The order is cut into buckets by the leading bits of a seeded hash. Sums run inside each bucket, and the buckets'
    totals, one row each, are summed over the source; so no window holds more than a bucket of documents.
    """
    count = sized.count()
    bits = max(0, math.ceil(math.log2(max(1, count / BUCKET_DOCUMENTS))))
    spread = F.xxhash64("doc_id", F.lit(seed))
    hashed = sized.withColumn("order", spread).withColumn("bucket", F.shiftright("order", 63 - bits).cast("bigint") if bits else F.lit(0).cast("bigint"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = settle(hashed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    started = hashed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return started.join(offsets, ["source", "bucket"]).withColumn("start", F.col("offset") + F.col("inside")).drop("order", "bucket", "offset", "inside")


def fitting(drawn: DataFrame, quotas: DataFrame, block_tokens: int) -> DataFrame:
    """The documents of ``drawn`` (doc_id, source, n_tokens, copies, max_repeats) of which one copy more, or less, would bring their
    source nearer to its quota without passing it; off is what the source is short of (or, below 0, over)."""
    have = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("have"))
    most = F.when(F.col("max_repeats").isNull(), F.col("quota") * block_tokens).otherwise(F.least(F.col("quota") * block_tokens, F.greatest("max_repeats", F.lit(0)) * F.col("source_tokens")))
    off = quotas.join(F.broadcast(have), "source").select("source", (most - F.col("have")).alias("off"))
    short = (F.col("off") > 0) & (F.col("max_repeats").isNull() | (F.col("copies") < F.col("max_repeats")))
    return drawn.join(F.broadcast(off), "source").filter(F.col("n_tokens").between(1, F.abs("off")) & (short | ((F.col("off") < 0) & (F.col("copies") > 0))))


def _made_up(drawn: DataFrame, quotas: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    """``drawn`` (settled) with one copy more or less of a few documents, until no document could bring its source nearer to its quota.

    In a round SPARE documents of each source and size are looked at, largest first; one is taken if it is no larger than what
    is still missing (or too much). So few rows per source meet, and no document goes below none or above its cap. Every
    round takes the largest that fits, so what is missing shrinks to less than the smallest document in a few rounds.
    """
    while True:
        spare = fitting(drawn, quotas, block_tokens).withColumn("size", F.floor(F.log2("n_tokens")))
        order = Window.partitionBy("source", "size").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        few = spare.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SPARE)
        queue = few.groupBy("source", "off").agg(F.sort_array(F.collect_list(F.struct("n_tokens", "doc_id")), asc=False).alias("queue"))
        start = F.struct(F.abs("off").alias("left"), F.slice(F.transform("queue", lambda q: q["doc_id"]), 1, 0).alias("ids"))
        step = lambda s, q: F.when(q["n_tokens"] <= s["left"], F.struct((s["left"] - q["n_tokens"]).alias("left"), F.concat(s["ids"], F.array(q["doc_id"])).alias("ids"))).otherwise(s)
        chosen = settle(queue.select(F.signum("off").cast("bigint").alias("more"), F.explode(F.aggregate("queue", start, step)["ids"]).alias("doc_id")))
        if chosen.isEmpty():
            return drawn
        changed = drawn.join(broadcast_if_small(chosen), "doc_id", "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))
        once = settle(changed.select(drawn.columns))
        discard(drawn)
        drawn = once


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(copies: doc_id, source, n_tokens, copies; shares: one row per source of ``targets``).

    The mix has about as many tokens as all documents of the sources of ``targets`` that have documents. copies is 0 for
    documents that are not drawn, and at most max_repeats (null: no limit; below 0 counts as 0). A null or negative target
    share is no share. Targets whose cap or lack of documents leaves tokens over pass these on to the others in proportion
    to their shares. Every source meets its quota so nearly that no document more or less would bring it nearer without passing it. Documents of other or null sources are left out; null and empty texts have no tokens and are drawn
    with the block they fall in. Spellings of a source that differ in case, outer blanks or separators are one; of several
    targets of one source the largest share and the largest cap hold. doc_id must be unique.
    """
    wanted = targets.filter(source_name("source").isNotNull()).groupBy(source_name("source").alias("source"))
    wanted = settle(wanted.agg(F.max("target_share").alias("target_share"), F.when(F.count("max_repeats") == F.count(F.lit(1)), F.max("max_repeats")).alias("max_repeats")))
    if wanted.count() > MOST_SOURCES:
        raise ValueError("too many sources")
    named = documents.select("doc_id", source_name("source").alias("source"), "text").join(F.broadcast(wanted.select("source")), "source", "left_semi")
    sized = settle(token_counts(named, ["doc_id", "source"], "text", vocabulary))
    spark = documents.sparkSession
    have = {r.source: r.tokens for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}  # a row per source
    parties = sorted(((r.source, max(r.target_share or 0.0, 0.0), r.max_repeats) for r in wanted.collect()), key=lambda p: (-p[1], p[0]))
    blocks = {s: -(-have.get(s, 0) // block_tokens) for s, _, _ in parties}
    total = round(sum(have.values()) / block_tokens)
    caps = [blocks[s] * max(repeats, 0) if repeats is not None else (None if blocks[s] else 0) for s, _, repeats in parties]
    quotas = apportion([share for _, share, _ in parties], caps, total)
    rows = []
    for (source, share, repeats), quota in zip(parties, quotas):
        n = blocks[source]
        full, rest = divmod(quota, n) if n else (0, 0)
        # All shards of a source have SHARD_BLOCKS blocks but the last, so highest quotients need only these two sizes.
        shards, tail = divmod(n, SHARD_BLOCKS)
        rows.append((source, float(share), repeats, int(have.get(source, 0)), n, quota, full, *_shard_quotas(rest, shards, tail)))
    plan = "source string, share double, max_repeats int, source_tokens bigint, n_blocks bigint, quota bigint, full bigint, each bigint, more bigint, last bigint, shards bigint"
    quota_table = F.broadcast(spark.createDataFrame(rows, plan))
    placed = _placed(sized, seed).join(quota_table, "source")
    block = F.least(F.floor(F.col("start") / block_tokens), F.col("n_blocks") - 1)
    shard = F.floor(block / SHARD_BLOCKS)
    takes = F.when(shard >= F.col("shards"), F.col("last")).otherwise(F.col("each") + F.when(shard < F.col("more"), 1).otherwise(0))
    copies = F.col("full") + F.when(F.pmod(block, F.lit(SHARD_BLOCKS)) < takes, 1).otherwise(0)
    drawn = settle(placed.select("doc_id", "source", "n_tokens", F.coalesce(copies, F.lit(0)).cast("bigint").alias("copies"), "max_repeats"))
    drawn = _made_up(drawn, spark.createDataFrame(rows, plan), block_tokens, seed).drop("max_repeats")
    reached = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("n_documents"))
    told = spark.createDataFrame(rows, plan).join(F.broadcast(reached), "source", "left").na.fill(0, ["mixed_tokens", "most_copies", "n_documents"])
    told = told.withColumn("all_tokens", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0))))  # a row per source
    shares = told.select(
        "source", F.col("share").alias("target_share"), "max_repeats", "n_documents", "source_tokens", F.col("quota").alias("quota_blocks"), "mixed_tokens", "most_copies",
        (F.col("quota") * block_tokens).alias("quota_tokens"), F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).alias("reached_share"),
    )
    return drawn, shares


def _shard_quotas(blocks: int, shards: int, tail: int) -> tuple[int, int, int, int]:
    """(blocks of every full shard, how many full shards get one more, blocks of the last shard, full shards) when ``blocks``
    are spread over ``shards`` shards of SHARD_BLOCKS blocks and one of ``tail``. Highest quotients serve equal shards in
    turn, so only the number that goes to the last shard has to be found."""
    n = shards * SHARD_BLOCKS + tail
    last = min(tail, math.floor(blocks * tail / n + 0.5)) if n else 0
    each, more = divmod(blocks - last, shards) if shards else (0, 0)
    if not shards:
        last = blocks
    return each, more, last, shards
