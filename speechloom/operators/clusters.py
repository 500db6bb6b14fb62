"""Density clusters of long recordings: neighbours by blocks of segments, clusters as components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.operators.graph import components
from speechloom.sources.shared import written

#: Segments of one recording that are compared at once: a task holds two blocks, and their distances.
BLOCK = 1024


def blocks(rows: DataFrame, group: str, key: str, vector: str, block: int) -> DataFrame:
    """(group, block, keys, vectors): the segments of a recording in blocks of about so many, as plain bytes. Vectors are of
    length one, or zero."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / block).alias("_n")).withColumnRenamed(group, "_g")
    dealt = rows.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).withColumn("block", F.pmod(F.xxhash64(key), "_n").cast("int"))
    cell = F.struct(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("x"))
    return dealt.groupBy(F.col(group).alias("grp"), "block").agg(F.sort_array(F.collect_list(cell)).alias("cells")).select("grp", "block", F.col("cells.key").alias("keys"), F.col("cells.x").alias("vectors"))


def _matrix(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def pairs_of(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Every two blocks of a recording, each with itself too."""
    side = lambda s: parts.select("grp", *[F.col(c).alias(f"{c}_{s}") for c in ("block", *columns)])
    a, b = side("a"), side("b").withColumnRenamed("grp", "_g")
    return a.join(b, F.col("grp").eqNullSafe(F.col("_g"))).where("block_a <= block_b").drop("_g")


def _near(row: dict, eps: float) -> np.ndarray:
    a, b = _matrix(row["vectors_a"]), _matrix(row["vectors_b"])
    near = 1 - a @ b.T <= eps
    if row["block_a"] == row["block_b"]:
        np.fill_diagonal(near, True)
    return near


def _value(x: pa.Scalar):
    """A cell as a number, an array, or, of arrays of one length, a matrix; no list is made of its values."""
    if not pa.types.is_list(x.type):
        return x.as_py()
    if pa.types.is_list(x.type.value_type):
        return x.values.flatten().to_numpy(zero_copy_only=False).reshape(len(x.values), -1)
    return x.values.to_numpy(zero_copy_only=False)


def _mapped(df: DataFrame, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for out in make({n: _value(c[i]) for n, c in zip(batch.schema.names, batch.columns, strict=True)}):
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def dbscan(rows: DataFrame, group: str, key: str, vector: str, eps: float, least: int = 2, block: int = BLOCK) -> DataFrame:
    """Clusters by cosine distance within each recording: (group, key, cluster), cluster the least key of its core segments,
    null for noise.

    A segment with at least so many segments (itself counts) within eps is a core; cores within eps of each other are of one
    cluster; another segment belongs to the cluster of the core of the least key within eps. Blocks of a recording meet in
    pairs, each pair a row of its own. A first pass counts neighbours; of the second only links that join cores anew within
    their pair of blocks go on, so what is shuffled grows with segments times blocks, not with pairs of segments. A vector of
    zeros is at distance 1 from all but itself; keys are whole numbers that no two rows share; rows without key or vector are
    left out.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    kind = rows.schema[group].dataType.simpleString()
    parts = written(blocks(rows, group, key, vector, block), "cluster-blocks")

    def count(row):
        near = _near(row, eps)
        yield {"key": pa.array(row["keys_a"], pa.int64()), "n": pa.array(near.sum(1), pa.int64())}
        if row["block_a"] < row["block_b"]:
            yield {"key": pa.array(row["keys_b"], pa.int64()), "n": pa.array(near.sum(0), pa.int64())}

    counts = _mapped(pairs_of(parts, ["keys", "vectors"]), "key long, n long", count).groupBy("key").agg(F.sum("n").alias("n"))
    cores = counts.where(F.col("n") >= least).select("key", F.lit(True).alias("core"))
    flat = parts.select("grp", "block", F.posexplode("keys").alias("at", "key"), F.col("vectors").alias("_v"))
    flags = flat.drop("_v").join(cores, "key", "left").groupBy("grp", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("core", F.lit(False)).alias("core")))), lambda c: c["core"]).alias("cores"))
    flags = flags.withColumnsRenamed({"grp": "_g", "block": "_b"})
    known = written(parts.join(flags, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b"), "cluster-cores")

    def link(row):
        near, ka, kb = _near(row, eps), row["keys_a"], row["keys_b"]
        ca, cb = row["cores_a"].astype(bool), row["cores_b"].astype(bool)
        a, b = forest(near & ca[:, None] & cb, row["block_a"] == row["block_b"])
        yield {"a": pa.array(ka[a], pa.int64()), "b": pa.array(kb[b] if row["block_a"] != row["block_b"] else ka[b], pa.int64()), "core": pa.array([True] * len(a), pa.bool_())}
        for rows_, keys, others, of in ((near, ka, kb, (~ca, cb)), (near.T, kb, ka, (~cb, ca))):
            mine, theirs = np.flatnonzero(of[0]), np.flatnonzero(of[1])
            if len(mine) and len(theirs):
                order = theirs[np.argsort(others[theirs])]
                hit = rows_[np.ix_(mine, order)]
                some = hit.any(1)
                yield {"a": pa.array(keys[mine[some]], pa.int64()), "b": pa.array(others[order[hit[some].argmax(1)]], pa.int64()), "core": pa.array([False] * int(some.sum()), pa.bool_())}

    links = written(_mapped(pairs_of(known, ["keys", "vectors", "cores"]), "a long, b long, core boolean", link), "cluster-links")
    roots = components(links.where("core").select("a", "b"))
    border = links.where("NOT core").groupBy(F.col("a").alias("key")).agg(F.min("b").alias("node"))
    of_core = cores.select("key").join(roots, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("cluster"))
    of_border = border.join(of_core.withColumnRenamed("key", "_k"), F.col("node") == F.col("_k")).select("key", "cluster")
    found = of_core.unionByName(of_border).withColumnRenamed("key", "_k")
    return rows.select(group, key).join(found, F.col(key) == F.col("_k"), "left").select(F.col(group).cast(kind).alias(group), key, "cluster")


def forest(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the rows and columns of a matrix as all its set cells do, but none twice: at most one for each row and
    column. Whole rows are joined at a time."""
    rows, columns = near.shape
    root = np.arange(rows if same else rows + columns)
    a, b = [], []
    for i in range(rows):
        ends = np.flatnonzero(near[i]) + (0 if same else rows)
        tops = root[ends]
        new, at = np.unique(tops, return_index=True)
        other = new != root[i]
        if other.any():
            a += [i] * int(other.sum())
            b += (ends[at[other]] - (0 if same else rows)).tolist()
            root[np.isin(root, new)] = root[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def well_split(clusters: DataFrame, group: str, cluster: str = "cluster", share: float = 0.15) -> DataFrame:
    """(group, clusters, least, several): the number of clusters, the least one's share of clustered segments, and whether
    there are at least two, none of them smaller than a share."""
    sizes = clusters.where(F.col(cluster).isNotNull()).groupBy(group, cluster).agg(F.count("*").alias("n"))
    own = sizes.groupBy(group).agg(F.count("*").alias("clusters"), (F.min("n") / F.sum("n")).alias("least"))
    return own.withColumn("several", (F.col("clusters") >= 2) & (F.col("least") >= share))
