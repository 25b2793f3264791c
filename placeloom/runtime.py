"""The folder shared by driver and executors, staged tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Edges of which one task finds the components at once.
AT_ONCE = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below a local one if all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        else:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="placeloom-")
            spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/placeloom-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _settled(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def least_labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component; edges are of numbers below n."""
    label, was = np.arange(n), None
    while was is None or (label != was).any():
        was = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
    return label


def _rooted(batches):
    """(u, v): v the least node of u's component, for all nodes u but the least, of edges (u, v) of one task."""
    parts = [[batch.column(c).to_numpy() for c in range(2)] for batch in batches]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        label = least_labels(at[: len(u)], at[len(u) :], len(nodes))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(u, v)``: returns ``(node, root)``, root the least node.

    Alternating large-star and small-star steps; each step is a partial minimum, staged, and an equi-join of two
    tables, which adaptive execution can split where a hub is skewed.  Steps are staged in the shared folder, and
    deleted once their round is over.  At most ``AT_ONCE`` edges that are left are solved by one task.  Self-loops make singletons; an empty table gives an empty result.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _settled(now)
    plain = all(isinstance(now.schema[c].dataType, T.LongType) for c in "uv")
    while state[0]:
        if plain and state[0] <= AT_ONCE:
            before, now = now, staged(now.coalesce(1).mapInArrow(_rooted, "u long, v long"))
            discard(before)
            break
        # Large star: each neighbour above u is linked to the least node around u.
        sym = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = staged(sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # Small star: u and its neighbours below are linked to the least of them.
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")))
        hop = large.join(low, "u")
        small = hop.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, now = now, staged(small.where("u <> v").distinct())
        discard(before, least, large, low)
        after = _settled(now)
        if after == state:
            break
        state = after
    return nodes.join(now, nodes.node == now.u, "left").select("node", F.coalesce("v", "node").alias("root"))
