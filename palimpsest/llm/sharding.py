"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, stash

#: Bits of the key's hash; bits that one level of the directory looks ahead.
BITS, STEP = 60, 8
#: Directory rows that may be broadcast, about 60 bytes each.
BROADCAST_BUCKETS = 100_000


def shard(documents: DataFrame, *, max_bytes: int = 64 << 20, overhead: int = 16) -> DataFrame:
    """Give every row (doc_id, text) a shard of at most ``max_bytes``.

    A row weighs the bytes of its text plus ``overhead``. The hash is the
    first 60 bits of md5 of doc_id as text. A bucket is a prefix of ``depth``
    bits; it splits on the next bit only while it is over the limit and holds
    more than one hash value. Rows that share one hash can't be told apart by
    more bits: such a bucket is cut into numbered parts, each within the
    limit: rows over half of it stand alone, the others are packed by running
    sum in the order of weight and text. Only a single row over the limit
    makes a larger shard. The same rows give the same shards in any layout.

    Returns doc_id, n_bytes, depth, prefix, part, shard_bytes (of the shard).
    Null text weighs ``overhead``; null doc_id hashes as empty. An empty
    table gives no rows. Other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = stash(
        documents.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("n_bytes"),
            F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long").alias("h"),
            F.xxhash64("text").alias("t"),
        ),
        "shard-sizes",
    )
    # Level by level: histogram of the buckets that are still open, folded up to each depth of the level.
    open_rows, levels, low = sized, [], 0
    while True:
        high = min(BITS, low + STEP)
        leaves = open_rows.groupBy(F.shiftright("h", BITS - high).alias("leaf")).agg(
            F.sum("n_bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        leaves = stash(leaves, "shard-leaves")
        depths = leaves.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
        depths = depths.withColumn("prefix", F.expr(f"shiftright(leaf, {high} - depth)"))
        sums = depths.groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        )
        whole = F.col("shard_bytes") <= max_bytes
        closed = sums.where(whole | (F.col("lo") == F.col("hi"))).withColumn("whole", whole)
        found = depths.select("leaf", "depth", "prefix").join(closed, ["depth", "prefix"])
        found = found.groupBy("leaf").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "whole")).alias("b"))
        directory = stash(leaves.select("leaf").join(found, "leaf", "left"), "shard-directory")
        n = directory.count()
        at = open_rows.withColumn("leaf", F.shiftright("h", BITS - high)).join(broadcast_if_small(directory, n, BROADCAST_BUCKETS), "leaf")
        levels.append(at.where("b is not null").select("doc_id", "n_bytes", "t", "b.*"))
        if high == BITS or directory.where("b is null").isEmpty():
            break
        open_rows, low = stash(at.where("b is null").select("doc_id", "n_bytes", "h", "t"), "shard-open"), high
    placed = reduce(DataFrame.unionByName, levels)
    done = placed.where("whole").select("doc_id", "n_bytes", "depth", "prefix", F.lit(0).cast("long").alias("part"), "shard_bytes")
    alike = _packed(placed.where("not whole").select("doc_id", "n_bytes", "t", "depth", "prefix"), max_bytes)
    return done.unionByName(alike.select(*done.columns))


def _packed(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Add part and shard_bytes to rows (depth, prefix, n_bytes, t) of buckets that bits can't split.

    Running sums go over ranges of the rows, so a bucket may hold any number.
    A part begins wherever the sum before a row passes the next multiple of
    the limit less the largest row to pack, which is at most half the limit.
    """
    bucket = ["depth", "prefix"]
    large = F.col("n_bytes") * 2 > max_bytes
    order = [*bucket, "n_bytes", "t", "spread"]  # spread parts rows that are alike in all and may change places
    dealt = rows.withColumn("spread", F.rand(7)).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    dealt = stash(dealt.withColumn("weight", F.when(large, 0).otherwise(F.col("n_bytes"))).withColumn("large", large.cast("long")), "shard-alike")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("range").agg(F.sum("weight").alias("w"), F.sum("large").alias("l"))
    starts = starts.select("range", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("l").over(before), F.lit(0)).alias("l0"))
    local = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.join(F.broadcast(starts), "range")  # one row for each shuffle partition
    sums = sums.withColumn("w1", F.col("w0") + F.coalesce(F.sum("weight").over(local), F.lit(0))).withColumn("l1", F.col("l0") + F.coalesce(F.sum("large").over(local), F.lit(0)))
    sums = stash(sums.select("doc_id", *bucket, "n_bytes", "large", "weight", "w1", "l1"), "shard-sums")
    first = sums.groupBy(*bucket).agg(F.min("w1").alias("wb"), F.min("l1").alias("lb"), F.max("weight").alias("most"), F.sum("weight").alias("all"))
    room = max_bytes - F.col("most")
    n_small = F.floor((F.col("all") + room - 1) / room)
    small = F.floor((F.col("w1") - F.col("wb")) / room)
    parts = sums.join(first, bucket).withColumn("part", F.when(F.col("large") == 1, n_small + F.col("l1") - F.col("lb")).otherwise(small).cast("long"))
    totals = parts.groupBy(*bucket, "part").agg(F.sum("n_bytes").alias("shard_bytes"))
    return parts.join(totals, [*bucket, "part"])
