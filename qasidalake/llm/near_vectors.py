"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``NEAREST`` reference points (pivots) in order of
nearness.  Vectors that are near to each other have most of them in common, so those of one
label that share at least ``SHARED`` pivots are candidates, and a candidate pair is
verified by its cosine in double precision.

* Equal vectors of one label are one node with a number of copies.
* Pivots are some of the nodes: about 2 * sqrt(nodes), ``MIN_PIVOTS`` to ``MAX_PIVOTS``, out of a sample of
  ``SAMPLED`` times as many, those of the least digests.  None is within a cosine of
  ``APART`` of another, so a group of near copies does not get many.  Every
  node is indexed; only the choice of pivots rests on the sample.
* Two sets of k pivots that share s of them share one of their first k - s + 1 in
  any common order.  Each node is posted under so many, its rarest ones.
* An inverted list, that of a label and a pivot, is dealt into blocks of about ``LIST_BLOCK`` nodes; each pair of
  blocks is a group of its own, so no list meets in one task.  A group counts shared
  pivots and verifies the candidates whose first common posted pivot is its own: each
  pair once.  It gives no pairs but sums: for each node the copies of the nodes that it
  links, and links that join the group's nodes as all its pairs would.

Links between the nodes of a dense group are all counted, so its comparisons grow with its square;
what is sent and written does not.  A null label, a null or zero vector and one with null, infinite or NaN entries
or another length than most links with nothing.  Copies of a vector link with each other.
Rows of repeated and null ids are all kept; of a component the least id names
it, and a row without an id is kept only if no row of its component has one.  An
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, written
from .near_duplicates import classes_of
from .vectors import common_length, from_bytes, is_finite, matrix

COSINE = 0.98
NEAREST, SHARED = 8, 3
MIN_PIVOTS, MAX_PIVOTS, SAMPLED, APART = 256, 16_384, 4, 0.9
LIST_BLOCK = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay zeros."""
    most = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / np.where(most > 0, most, 1.0)
    size = np.linalg.norm(scaled, axis=1, keepdims=True)
    return scaled / np.where(size > 0, size, 1.0)


def keyed_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str, length: int) -> DataFrame:
    """(id, node, label, vector) of all rows: node is a digest of label and vector, null where a row links with nothing."""
    ok = F.col(label_col).isNotNull() & is_finite(F.col(vec_col)) & (F.size(vec_col) == length)
    rows = df.select(F.col(id_col).alias("id"), F.when(ok, F.col(label_col).cast("string")).alias("label"), F.when(ok, F.col(vec_col)).alias("vector"))

    def run(batches):
        for batch in batches:
            labels, held = batch.column(1).to_pylist(), np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            node, data = [None] * len(labels), [None] * len(labels)
            raw = matrix(batch.column(2).take(pa.array(held)), length)
            for i, own, v in zip(held, raw, unit(raw)):
                if v.any():
                    node[i] = hashlib.md5(labels[i].encode() + b"\0" + (own + 0.0).tobytes(), usedforsecurity=False).digest()
                    data[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.binary()), batch.column(1), pa.array(data, pa.binary())], ["id", "node", "label", "vector"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, node binary, label string, vector binary")


def choose_pivots(nodes: DataFrame, n_nodes: int, length: int, least: int = MIN_PIVOTS, most: int = MAX_PIVOTS) -> np.ndarray:
    """Reference points that lie apart, out of a sample of bounded size; the first of a tie is that of the least digest."""
    n = int(min(most, max(least, 2 * n_nodes**0.5)))
    sample = [np.frombuffer(r["vector"], np.float64) for r in nodes.select("node", "vector").orderBy("node").limit(SAMPLED * n).collect()]
    chosen, k = np.zeros((n, length)), 0
    for v in sample:
        if k < n and (k == 0 or (chosen[:k] @ v).max() < APART):
            chosen[k], k = v, k + 1
    return chosen[:k]


def nearest_pivots(nodes: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """The nodes with ``pivots``, the places of their nearest ones, nearest first."""
    length = pivots.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                near = from_bytes(part.column("vector"), np.float64, length) @ pivots.T
                some = np.argpartition(-near, nearest - 1, axis=1)[:, :nearest]
                order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
                places = np.take_along_axis(some, order, 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(places), pa.list_(pa.int32()))], [*part.schema.names, "pivots"])

    kinds = ", ".join(f"{c} {t}" for c, t in nodes.dtypes)
    return nodes.mapInArrow(run, f"{kinds}, pivots array<int>")


def posted_pivots(near: DataFrame, rank: np.ndarray, n: int) -> DataFrame:
    """The nodes with ``posted``, the ``n`` of their pivots that ``rank`` puts first, in its order."""

    def run(batches):
        for batch in batches:
            posted = [sorted(p, key=rank.__getitem__)[:n] for p in batch.column("pivots").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(posted, pa.list_(pa.int32()))], [*batch.schema.names, "posted"])

    return near.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in near.dtypes) + ", posted array<int>")


def least_linked(adjacent: np.ndarray) -> np.ndarray:
    """The least place that each row of a symmetric matrix reaches."""
    root = np.arange(len(adjacent))
    while True:
        least = np.where(adjacent, root, len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def links_of_group(length: int, cosine: float, shared: int):
    """For ``applyInArrow``: the links of two blocks of an inverted list as (node, n, other)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node = group.column("node").to_pylist()
        side, copies = group.column("side").to_numpy(), group.column("copies").to_numpy()
        pivot, own = group.column("pivot")[0].as_py(), group.column("i")[0].as_py() == group.column("j")[0].as_py()
        vectors = from_bytes(group.column("vector").combine_chunks(), np.float64, length)
        sets, posted = (np.array(group.column(c).to_pylist(), np.int32) for c in ("pivots", "posted"))
        a, b = (np.arange(len(node)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        # of the pivots before this one in the common order none may be common: such a pair belongs to that list
        before = np.where(np.cumsum(posted == pivot, axis=1) == 0, posted, -1)

        def among(x, y):
            """How many entries, -1 aside, each row of x has in common with each row of y."""
            names = np.unique(np.concatenate([x.ravel(), y.ravel()]))
            bits = [np.zeros((len(z), len(names)), np.float32) for z in (x, y)]
            for bit, z in zip(bits, (x, y)):
                np.put_along_axis(bit, np.searchsorted(names, z), 1, 1)
                bit[:, names < 0] = 0
            return bits[0] @ bits[1].T

        good = (among(sets[a], sets[b]) >= shared) & (among(before[a], before[b]) == 0)
        good &= vectors[a] @ vectors[b].T >= cosine
        if own:
            np.fill_diagonal(good, False)
        whole = np.zeros((len(node), len(node)), bool)
        whole[np.ix_(a, b)] = good
        whole |= whole.T
        linked, root = whole.astype(np.float64) @ copies, least_linked(whole)
        held = np.flatnonzero(linked)
        return pa.table({"node": pa.array([node[k] for k in held], pa.binary()), "n": pa.array(linked[held].astype(np.int64)), "other": pa.array([node[root[k]] for k in held], pa.binary())})

    return run


def partial_links(nodes: DataFrame, length: int, work: Scratch, cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED, least_pivots: int = MIN_PIVOTS, block: int = LIST_BLOCK) -> DataFrame:
    """(node, n, other) of nodes (node, label, vector, copies): parts of each node's number of links, and links that join them."""
    n_nodes = nodes.count()
    pivots = choose_pivots(nodes, n_nodes, length, least_pivots)
    nearest = min(nearest, len(pivots))
    shared = min(shared, nearest)
    near = work.written(nearest_pivots(nodes, pivots, nearest), "near") if nearest else nodes.withColumn("pivots", F.array().cast("array<int>"))
    sizes = {r["pivot"]: r["count"] for r in near.select(F.explode("pivots").alias("pivot")).groupBy("pivot").count().collect()}  # a number for each pivot
    order = sorted(range(len(pivots)), key=lambda p: (sizes.get(p, 0), p))
    posts = posted_pivots(near, np.argsort(order), nearest - shared + 1).withColumn("pivot", F.explode("posted"))
    lists = posts.groupBy("label", "pivot").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    lists = lists.select("label", "pivot", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    dealt = posts.join(lists, ["label", "pivot"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    dealt = dealt.select("label", "pivot", "i", "j", "side", "node", "copies", "pivots", "posted", "vector")
    return dealt.groupBy("label", "pivot", "i", "j").applyInArrow(links_of_group(length, cosine, shared), "node binary, n long, other binary")


def near_vector_links(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, **index) -> DataFrame:
    """(id, n_links, component_id, kept) of each row; ``index``: the parameters of ``partial_links``."""
    spark, length = df.sparkSession, common_length(df, vec_col)
    work = Scratch(spark, "near-vectors")
    try:
        keyed = work.written(keyed_vectors(df, id_col, vec_col, label_col, length), "keyed")
        firsts = [F.first(c).alias(c) for c in ("label", "vector")]  # equal in all rows of a node
        nodes = keyed.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *firsts)
        nodes = work.written(nodes, "nodes")
        links = work.written(partial_links(nodes.drop("id"), length, work, cosine, **index), "links")
        joins = links.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
        roots = classes_of(joins, work, links.count())
        own = nodes.select("node", "id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = own.groupBy("root").agg(F.min("id").alias("component_id"))
        counts = links.groupBy("node").agg(F.sum("n").alias("n"))
        found = own.join(counts, "node", "left").join(least, "root").select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
        rows = keyed.select("id", "node").join(found, "node", "left")
        alone = F.col("node").isNull()
        component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
        rows = rows.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
        result = written(rows, "near-vector-rows")
    finally:
        work.clear()
    return result.withColumnRenamed("id", free_name(["n_links", "component_id", "kept"], id_col))
