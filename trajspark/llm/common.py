"""Helpers shared by the training-data operators: materialised tables and connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of a table (rows times the width that its columns have, as Spark reckons it) that may be broadcast
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one of our own only on a local master without one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="trajspark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets the executors' Python import this package, also where it isn't installed; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = Path(__file__).resolve().parents[1]
        at = tempfile.mkdtemp(prefix="trajspark-zip-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/{top.name}", "zip", top.parent, top.name))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it back: it is computed once, and its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes materialised tables that nothing reads any more."""
    for t in tables:
        for file in t.inputFiles()[:1]:
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows are within limit, else df itself. df should be materialised.

    A row's width is 8 bytes more than its columns' default widths; strings count as 64 bytes, as digests and paths have.
    """
    width = 8 + sum(64 if f.dataType.typeName() in ("string", "binary") else 8 for f in df.schema.fields)
    rows = limit // width
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that is linked to a smaller one; component is the smallest id reachable.

    edges: pairs of ids; direction, repeats, self links and nulls don't matter. Nodes that are missing in the result are
    the smallest of their component (or in no link). Each round hooks every node to its smallest neighbour, flattens
    the trees by pointer jumping, and contracts them, so rounds and jumps grow with the logarithm of the longest path.
    """
    kind = edges.schema[a].dataType
    links = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    links = materialize(links, "links")
    labels = None
    while not links.isEmpty():
        tree = materialize(links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent")), "tree")
        while True:
            up = tree.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = materialize(
                tree.join(up, "parent", "left").select(
                    "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")
                ),
                "jump",
            )
            flat = jumped.where("moved").isEmpty()
            discard(tree)
            tree = jumped.drop("moved")
            if flat:
                break
        left = materialize(_relabel(_relabel(links, tree, "u"), tree, "v").where("u <> v").select(
            F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
        discard(links)
        links = left
        if labels is None:
            labels = tree
        else:
            all_labels = materialize(_relabel(labels, tree, "parent").unionByName(tree), "labels")
            discard(labels, tree)
            labels = all_labels
    if labels is None:
        return links.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("component"))
    return labels.select("node", F.col("parent").alias("component"))


def _relabel(df: DataFrame, tree: DataFrame, column: str) -> DataFrame:
    to = tree.select(F.col("node").alias(column), F.col("parent").alias("_to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def clash_free(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names (an operator's own result columns replace them)."""
    return df.drop(*names)


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
