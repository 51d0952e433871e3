"""Shared storage, lineage cuts, joins with hot keys, and connected components."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one in the warehouse, which is shared too."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/placeweave-shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def spread(scan: DataFrame) -> DataFrame:
    """A scan of rows that are costly to work on, dealt out anew only if its few files would leave cores idle; large tables are read where they lie."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a reliable checkpoint in the shared folder; lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that was written at fresh_path and that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over: it does so when the driver's garbage is collected, which may be never in a short run."""
    for _ in range(2):  # events of the last job that are still under way hold its plan
        time.sleep(0.4)
        gc.collect()
        spark._jvm.System.gc()


#: Ids that are broadcast, 8 bytes each; more are joined by a shuffle.
FEW_IDS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """ids, broadcast up to FEW_IDS: what is filtered by them, such as texts, is then not shuffled. ids should be cheap to read."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which is aggregated by key: a hot key's rows of left can be split over tasks.

    The join also compares a second column derived from the key, so the aggregate's own partitioning doesn't serve it
    and both sides get an exchange of their own, whose skewed partitions adaptive execution splits.
    """
    second = "_second_key"
    derived = F.xxhash64(key).bitwiseAND(F.lit(1).cast("long"))  # one bit, so that it costs next to nothing in a shuffle
    return left.withColumn(second, derived).join(right.withColumn(second, derived), [key, second], how).drop(second)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an undirected edge list of longs without nulls.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). A node's neighbours meet only as their minimum,
    so no hub is gathered in one task. The state is checkpointed each round; only a change counter reaches the driver.
    """
    pairs = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = skew_join(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, low, "u").select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u <> v").distinct()
        pairs = cut(small)
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    stars = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").union(stars.select(F.col("component").alias("node"), "component").distinct())
