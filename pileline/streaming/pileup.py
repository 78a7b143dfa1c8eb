"""Pileup over a stream of reads.

Position is the event time: one second a place. A site is final when the watermark, which follows the greatest position
seen less ``lateness`` places, has passed it; what comes later is dropped, or is an error where that is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pileup import bases
from ..params import CallParams

#: Keeps states outside of the executors' heap.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pileup_stream(reads: DataFrame, params: CallParams = CallParams(), lateness: int = 1_000) -> DataFrame:
    """Counts of each site of a stream of reads (0-based positions), emitted when the site is closed. Stateful per (chr, pos)
    in the state store; the depth cap, which needs the order of arrival, belongs to the batch form."""
    reads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = bases(reads, params).withColumn("at", F.timestamp_seconds("pos")).withWatermark("at", f"{lateness} seconds")
    u = F.col("eligible") & (F.col("hit") == 1)
    counts = [F.count(F.lit(1)).alias("depth"), F.sum("hit").alias("repeat_time"), F.sum(u.cast("long")).alias("dep_uni")]
    for k in range(4):
        own = F.col("base") == k
        counts += [F.sum((u & own).cast("long")).alias(f"uni{k}"), F.sum(F.when(u & own, F.col("q")).otherwise(0)).alias(f"qs{k}"), F.sum((F.col("eligible") & own).cast("long")).alias(f"all{k}")]
    return rows.groupBy("chr", F.window("at", "1 second").alias("w")).agg(*counts).select("chr", F.unix_timestamp("w.start").alias("pos"), *[c for c in ("depth", "repeat_time", "dep_uni")], *[f"{c}{k}" for k in range(4) for c in ("uni", "qs", "all")])


def windows_stream(reads: DataFrame, size: int = 262_144, lateness: int = 1_000) -> DataFrame:
    """(chr, block, reads, last) of tumbling windows of ``size`` places."""
    rows = reads.withColumn("at", F.timestamp_seconds("pos")).withWatermark("at", f"{lateness} seconds")
    out = rows.groupBy("chr", F.window("at", f"{size} seconds").alias("w")).agg(F.count(F.lit(1)).alias("reads"), F.max("pos").alias("last"))
    return out.select("chr", (F.unix_timestamp("w.start") / size).cast("long").alias("block"), "reads", "last")


def refuse_late(batch: DataFrame, closed: DataFrame) -> DataFrame:
    """For foreachBatch: the batch, or an error if a read starts in a place that is closed for its contig (chr, upto)."""
    upto = closed.select(F.col("chr").alias("__c"), "upto")
    late = F.col("upto").isNotNull() & (F.col("pos") < F.col("upto"))
    return batch.join(upto, F.col("chr") == F.col("__c"), "left").filter(F.when(late, F.raise_error(F.concat(F.lit("late read "), F.col("read_idx").cast("string"))).isNull()).otherwise(F.lit(True))).drop("__c", "upto")
