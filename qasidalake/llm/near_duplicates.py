"""Near-duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified.

A text is the weighted set of its five-word shingles.  A shingle weighs its count
times an inverse document frequency, 1 plus the mean over its words of
ln((n + 1) / (df + 1)) / ln(n + 1).  The document frequencies are of all documents,
counted in ``FREQUENCY_BUCKETS`` hashed buckets of words, so their table has one
size at every scale.  Improved consistent weighted sampling gives ``BANDS`` times
``ROWS`` samples; two texts agree in a sample with the probability of their
weighted Jaccard similarity.

Equal texts are one node.  Nodes that agree in all samples of a band share a
bucket.  A node's rank is the number of nodes in all its buckets, which is highest
near the middle of a group; a bucket's node of the highest rank is its hub.  Three
rounds verify weighted Jaccard similarity of 0.8 or more, and join nodes into classes:

1. each node with the hubs of its buckets;
2. each node that is not in a hub's class with the likeliest other node of that bucket;
3. each such node with all others of the bucket that are in other classes.

So buckets of any size are handled by links to a hub, and what the hub does not
explain is still compared with everything in its bucket.  Rounds 2 and 3 compare
bit sketches and total weights first: a bucket is dealt into blocks of about
``BLOCK`` nodes, each pair of blocks is one small group, and a group gives only
pairs (round 2: one a node) whose sketches leave the similarity possible.  A sketch
deals a shingle's weight, in eighths, into ``BITS`` bins and keeps one bit of each
bin's least hash: of N bins that either text fills, two texts differ in about
N * (1 - similarity) / 2.  ``deviations`` says by how many standard deviations
more they may differ; ``None`` verifies every pair of a bucket exactly.

A null text counts as empty.  Texts without words equal only their own copies.
Every row gets a class; repeated and null ids are all kept.  Texts of any length are
sampled whole, in blocks.  Ties between hubs go to the lesser digest; a class is named
after its least id, and of equal ids the lesser digest is kept.  An empty table has
no rows in its result.  Columns of any other name pass through ``without_near_duplicates``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, parts_of, written
from .shingles import SIZE, mixed, shingle_hashes, words_by_text

SIMILARITY = 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
#: Bins of a sketch, units of a weight of 1, and by how many standard deviations rounds 2 and 3 let sketches differ more.
BITS, UNITS, DEVIATIONS = 2048, 8, 3.5
#: Nodes of a block in rounds 2 and 3; rows for each task of the tables that are written, by how wide they are.
BLOCK = 128
WIDE_ROWS, NARROW_ROWS = 20_000, 100_000
FREQUENCY_BUCKETS, FREQUENCY_SLICES = 1 << 16, 16

# Consistent sampling: for each shingle and sample, Gamma(2, 1) draws r and c and a
# uniform draw b come out of tables, at places that a hash of both gives.
_BITS = 13
_RNG = np.random.RandomState(987_631)
_R = _RNG.gamma(2.0, 1.0, 1 << _BITS).astype(np.float32).clip(1e-3)
_INVERSE_R = (1 / _R).astype(np.float32)
_LOG_C = np.log(_RNG.gamma(2.0, 1.0, 1 << _BITS)).astype(np.float32)
_B = _RNG.uniform(0.0, 1.0, 1 << _BITS).astype(np.float32)
_FACTORS = _RNG.randint(1, 1 << 62, size=SAMPLES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def samples(hashes: np.ndarray, weights: np.ndarray, block: int = 2048) -> np.ndarray:
    """The ``SAMPLES`` consistent samples of a weighted set, as 64-bit numbers."""
    best = np.full(SAMPLES, np.inf, np.float32)
    shingle, step = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
    mask, column = np.uint64((1 << _BITS) - 1), np.arange(SAMPLES)
    for lo in range(0, len(hashes), block):
        h = hashes[lo : lo + block]
        x = (h[:, None] * _FACTORS) >> np.uint64(64 - 3 * _BITS)
        i = (x & mask).astype(np.intp)
        b = _B[((x >> np.uint64(_BITS)) & mask).astype(np.intp)]
        log_c = _LOG_C[(x >> np.uint64(2 * _BITS)).astype(np.intp)]
        t = np.floor(np.log(weights[lo : lo + block]).astype(np.float32)[:, None] * _INVERSE_R[i] + b)
        log_a = log_c - _R[i] * (t - b + 1)
        at = log_a.argmin(axis=0)
        least = log_a[at, column]
        better = least < best
        best[better] = least[better]
        shingle[better] = h[at[better]]
        step[better] = t[at[better], column[better]].astype(np.int64)
    return mixed(shingle + mixed(step.view(np.uint64)))


def bit_sketch(hashes: np.ndarray, counts: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, int]:
    """One bit of the least hash in each of ``BITS`` bins, as 64-bit numbers, and the units that were dealt."""
    # rounded up or down by the shingle's hash: the same way in every text, and right on the average
    share = (mixed(hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(11)) * 2.0**-53
    units = counts * np.floor((1 + mean) * UNITS + share).astype(np.int64)
    ends = np.cumsum(units)
    nth = np.arange(ends[-1]) - np.repeat(ends - units, units)
    x = np.sort(mixed(np.repeat(hashes, units) + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
    bins = (x >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    least = np.flatnonzero(np.diff(bins, prepend=-1))
    bits = np.zeros(BITS, np.uint8)
    bits[bins[least]] = (x[least] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64), int(ends[-1])


def document_frequency_table(df: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents by hashed bucket of words, and the number of documents; a table of fixed size."""
    size = FREQUENCY_BUCKETS // FREQUENCY_SLICES

    def count(batches):
        counts = np.zeros(FREQUENCY_BUCKETS, np.int64)
        for part in parts_of(batches, 0, 1 << 20):
            words, bounds = words_by_text([t or b"" for t in part.column(0).to_pylist()])
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) << 16
            held = np.unique(doc | (words & np.uint64(FREQUENCY_BUCKETS - 1)).astype(np.int64))
            counts += np.bincount(held & (FREQUENCY_BUCKETS - 1), minlength=FREQUENCY_BUCKETS)
        if counts.any():
            where = [TaskContext.get().partitionId() % 64] * FREQUENCY_SLICES
            data = [counts[i * size : (i + 1) * size].tobytes() for i in range(FREQUENCY_SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(FREQUENCY_SLICES), pa.int32()), pa.array(where, pa.int32()), pa.array(data, pa.binary())], ["slice", "lot", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for data in table.column("counts").to_pylist():
            total += np.frombuffer(data, np.int64)
        return pa.table({"slice": table.column("slice")[:1], "lot": table.column("lot")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "slice int, lot int, counts binary"
    parts = df.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(count, schema)
    parts = parts.groupBy("slice", "lot").applyInArrow(summed, schema).groupBy("slice").applyInArrow(summed, schema)
    table = np.zeros(FREQUENCY_BUCKETS, np.int64)
    for r in parts.collect():  # FREQUENCY_BUCKETS numbers in all
        table[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["counts"], np.int64)
    return table, df.count()


def inverse_frequencies(counts: np.ndarray, rows: int) -> np.ndarray:
    """By bucket, ln((n + 1) / (df + 1)) / ln(n + 1): 0 to 1."""
    if rows < 1:
        return np.zeros(len(counts), np.float32)
    return (np.log((rows + 1) / (counts + 1)) / np.log(rows + 1)).astype(np.float32)


def counted_shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of a text, ascending, their counts and mean inverse frequencies."""
    own = idf[(words & np.uint64(FREQUENCY_BUCKETS - 1)).astype(np.intp)]
    hashes = shingle_hashes(words)
    if len(words) < SIZE:
        mean = own.mean(keepdims=True) if len(words) else own
    else:
        sums = np.concatenate([[0.0], np.cumsum(own, dtype=np.float64)])
        mean = (sums[SIZE:] - sums[:-SIZE]) / SIZE
    distinct, first, count = np.unique(hashes, return_index=True, return_counts=True)
    return distinct, count, mean[first]


def weighted_shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, ascending, and their weights."""
    distinct, count, mean = counted_shingles(words, idf)
    return distinct, (count * (1 + mean)).astype(np.float32)


def weighted_jaccard(a_hashes, a_weights, b_hashes, b_weights) -> float:
    """Sum of the lesser weights over the sum of the greater ones; hashes ascend."""
    if not len(a_hashes) or not len(b_hashes):
        return 0.0
    place = np.minimum(np.searchsorted(b_hashes, a_hashes), len(b_hashes) - 1)
    same = b_hashes[place] == a_hashes
    less = float(np.minimum(a_weights[same], b_weights[place[same]]).sum(dtype=np.float64))
    return less / (float(a_weights.sum(dtype=np.float64)) + float(b_weights.sum(dtype=np.float64)) - less)


def sketches(df: DataFrame, id_col: str, text_col: str, idf: np.ndarray) -> DataFrame:
    """(id, node, weight, bands, bits, units) of each row; node is a digest of the text."""
    kind = dict(df.dtypes)[id_col]
    salts = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches):
        for part in parts_of(batches, 1, 1 << 20):
            texts = [t or b"" for t in part.column(1).to_pylist()]
            words, bounds = words_by_text(texts)
            weight, bands, bits, units = [], [], [], []
            for i in range(len(texts)):
                hashes, counts, mean = counted_shingles(words[bounds[i] : bounds[i + 1]], idf)
                weights = (counts * (1 + mean)).astype(np.float32)
                weight.append(float(weights.sum(dtype=np.float64)))
                if not len(hashes):
                    bands.append([])
                    bits.append([])
                    units.append(0)
                    continue
                found = samples(hashes, weights).reshape(BANDS, ROWS)
                band = salts.copy()
                for row in range(ROWS):
                    band = mixed(band * np.uint64(31) + found[:, row])
                bands.append(band.view(np.int64))
                sketch, dealt = bit_sketch(hashes, counts, mean)
                bits.append(sketch)
                units.append(dealt)
            nodes = [hashlib.md5(t, usedforsecurity=False).digest() for t in texts]
            columns = [part.column(0), pa.array(nodes, pa.binary()), pa.array(weight, pa.float64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(units, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "weight", "bands", "bits", "units"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, node binary, weight double, bands array<long>, bits array<long>, units long")


def _sets(df: DataFrame, idf: np.ndarray) -> DataFrame:
    """(node, hashes, weights) of rows (node, text)."""

    def run(batches):
        for part in parts_of(batches, 1, 1 << 20):
            words, bounds = words_by_text([t or b"" for t in part.column(1).to_pylist()])
            found = [weighted_shingles(words[bounds[i] : bounds[i + 1]], idf) for i in range(len(bounds) - 1)]
            columns = [part.column(0), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "hashes", "weights"])

    return df.mapInArrow(run, "node binary, hashes binary, weights binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough."""

    def run(batches):
        for batch in batches:
            a, b, *rest = (c.to_pylist() for c in batch.columns)
            good = []
            for x, y, xh, xw, yh, yw in zip(a, b, *rest):
                s = weighted_jaccard(np.frombuffer(xh, np.uint64), np.frombuffer(xw, np.float32), np.frombuffer(yh, np.uint64), np.frombuffer(yw, np.float32))
                if s >= similarity - 1e-9:
                    good.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.binary()), pa.array([g[1] for g in good], pa.binary())], ["a", "b"])

    def of(side: str) -> DataFrame:
        return sets.select(F.col("node").alias(side), F.col("hashes").alias(f"{side}_hashes"), F.col("weights").alias(f"{side}_weights"))

    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", "a_hashes", "a_weights", "b_hashes", "b_weights").mapInArrow(run, "a binary, b binary")


def classes_of(links: DataFrame, work: Scratch, rows: int) -> DataFrame:
    """(node, root) of all nodes of the links (a, b): root is the least node that is linked, over any number of steps.

    Each round hooks every root to the least of its neighbours, if that is less,
    shortens the paths by doubling, and goes on with the links between different
    roots.  Tables are written after each step, in tasks for at most ``rows`` links.
    """
    tasks = -(-2 * rows // NARROW_ROWS)
    roots, left = None, links.select("a", "b")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = work.written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "hooks", tasks)
        while True:
            up = hooks.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("above"))
            longer = hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            longer = work.written(longer, "hooks", tasks)
            hooks = longer.select("node", "root")
            if longer.where("moved").isEmpty():
                break
        if roots is None:
            roots = hooks
        else:
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = work.written(roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots", tasks)
        ends = hooks.select("node", "root")
        left = left.join(ends.toDF("a", "a_root"), "a").join(ends.toDF("b", "b_root"), "b")
        left = work.written(left.where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "links", tasks)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if roots is None else roots


def possible_pairs(similarity: float, deviations: float | None, best_only: bool):
    """For ``applyInArrow``: of a group of lone nodes and members of a bucket, the pairs (a, b, excess) that may be similar.

    ``excess`` is by how many deviations the sketches differ more than texts of that
    similarity do on average; ``best_only`` gives each lone node's least one.
    """

    def run(group: pa.Table) -> pa.Table:
        lone = np.array(group.column("is_lone").to_pylist(), bool)
        node, root = (np.array(group.column(c).to_pylist(), object) for c in ("node", "root"))
        weight, units = (group.column(c).to_numpy() for c in ("weight", "units"))
        bits, bands = (np.array(group.column(c).to_pylist(), np.int64).view(np.uint64) for c in ("bits", "bands"))
        band = group.column("band")[0].as_py()
        own, other = np.flatnonzero(lone), np.flatnonzero(~lone)
        a, b, excess = [], [], []
        for i in own:
            least, most = np.minimum(weight[i], weight[other]), np.maximum(weight[i], weight[other])
            near = (least >= most * (similarity - 1e-6)) & (root[i] != root[other])
            # a pair is made in the first band in which it agrees, once
            near &= (bands[i] == bands[other]).argmax(axis=1) == band
            js = other[near]
            if not len(js):
                continue
            union = (units[i] + units[js]) / (1 + similarity)  # at the least similarity
            filled, share = BITS * (1 - np.exp(-union / BITS)), (1 - similarity) / 2
            over = np.bitwise_count(bits[i] ^ bits[js]).sum(axis=1, dtype=np.int64) - filled * share
            over = over / np.sqrt(filled * (share * (1 - share)))
            if deviations is not None:
                js, over = js[over <= deviations], over[over <= deviations]
            if best_only and len(js):
                at = min(range(len(js)), key=lambda k: (over[k], node[js[k]]))
                js, over = js[at : at + 1], over[at : at + 1]
            a += [node[i]] * len(js)
            b += list(node[js])
            excess += over.tolist()
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "excess": pa.array(excess, pa.float64())})

    return run


class Duplicates:
    """The tables that classes are read from: ``rows`` (id, node) and ``classes`` (node, class_id, keep_node, ...)."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, deviations: float | None = DEVIATIONS):
        self.df, self.id_col, self.text_col, self.similarity, self.deviations = df, id_col, text_col, similarity, deviations
        table, n_rows = document_frequency_table(df, text_col)
        idf, self.wide = inverse_frequencies(table, n_rows), -(-n_rows // WIDE_ROWS)
        sketched = written(sketches(df, id_col, text_col, idf), "sketches")
        self.rows = sketched.select("id", "node")
        self.work = Scratch(df.sparkSession, "near-duplicates")
        firsts = [F.first(c).alias(c) for c in ("weight", "bands", "bits", "units")]  # equal in all rows of a node
        nodes = sketched.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *firsts)
        self.classes = self._classes(self.work.written(nodes, "nodes"), idf)
        self.work.clear()

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of some nodes (node, id), by their ids; the digest tells rows of one id apart."""
        text = F.coalesce(F.col(self.text_col).cast("string"), F.lit("")).cast("binary")
        rows = self.df.select(F.col(self.id_col).alias("own"), text.alias("text"))
        found = rows.join(nodes, F.col("own").eqNullSafe(F.col("id"))).where(F.unhex(F.md5("text")) == F.col("node"))
        return found.select("node", "text")

    def _shared(self, nodes: DataFrame) -> DataFrame:
        """(band, bucket, a, b, ...): each node a of a shared bucket with the bucket's hub b."""
        members = nodes.select("node", "weight", F.posexplode("bands").alias("band", "bucket"))
        sizes = members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        held = self.work.written(members.join(sizes, ["band", "bucket"]), "held", BANDS * self.wide // 4 + 1)
        held = held.join(held.groupBy("node").agg(F.sum(-F.col("size")).alias("rank")), "node")
        hubs = held.groupBy("band", "bucket").agg(F.min(F.struct("rank", "node", "weight")).alias("hub"))
        shared = held.join(hubs, ["band", "bucket"]).where(F.col("node") != F.col("hub.node"))
        shared = shared.select("band", "bucket", F.col("node").alias("a"), F.col("hub.node").alias("b"), "weight", F.col("hub.weight").alias("hub_weight"))
        return self.work.written(shared, "shared", BANDS * self.wide // 4 + 1)

    def _classes(self, nodes: DataFrame, idf: np.ndarray) -> DataFrame:
        shared = self._shared(nodes)
        wanted = shared.select(F.col("a").alias("node")).union(shared.select(F.col("b").alias("node"))).distinct()
        sets = self.work.written(_sets(self._texts(nodes.select("node", "id").join(wanted, "node")), idf).dropDuplicates(["node"]), "sets", 8 * self.wide)

        possible = F.least("weight", "hub_weight") >= F.greatest("weight", "hub_weight") * (self.similarity - 1e-6)
        links, n_links, roots = None, 0, None
        for best_only in (None, True, False):
            if best_only is None:
                pairs = shared.where(possible).select("a", "b").distinct()
            else:
                pairs = self._unexplained(shared, nodes, roots, best_only)
            # distinct: its shuffle is read in few tasks, the pairs are verified in many
            more = self.work.written(_verified(pairs, sets, self.similarity).distinct(), "links", self.wide)
            if n_more := more.count():
                links, n_links = more if links is None else links.unionByName(more), n_links + n_more
            if n_more or roots is None:
                roots = classes_of(more if links is None else links, self.work, n_links)

        own = nodes.select("node", "id", "copies").join(roots, "node", "left").select("node", "id", "copies", F.coalesce("root", "node").alias("root"))
        least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("keep")
        grouped = own.groupBy("root").agg(least, F.sum("copies").alias("class_size"))
        grouped = grouped.select("root", F.col("keep.id").alias("class_id"), F.col("keep.node").alias("keep_node"), "class_size")
        return written(own.select("node", "root", "copies").join(grouped, "root").drop("root"), "classes", self.wide)

    def _unexplained(self, shared: DataFrame, nodes: DataFrame, roots: DataFrame, best_only: bool) -> DataFrame:
        """Pairs (a, b) for rounds 2 and 3: lone nodes (not in their hub's class) with members of their buckets.

        Of two nodes in different classes one is lone in every bucket that both
        share, so a pair is made in the first band in which they agree.
        """
        spots = shared.select("band", "bucket", "a", "b").join(roots.toDF("a", "a_root"), "a", "left").join(roots.toDF("b", "b_root"), "b", "left")
        spots = spots.select("band", "bucket", F.col("a").alias("node"), (F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).alias("lone"))
        counts = spots.groupBy("band", "bucket").agg(F.count_if("lone").alias("n_lone"), F.count(F.lit(1)).alias("n_all")).where("n_lone > 0 AND n_all > 1")
        blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        counts = counts.select("band", "bucket", blocks("n_lone").alias("lone_blocks"), blocks("n_all").alias("all_blocks"))
        spots = self.work.written(spots.join(counts, ["band", "bucket"]), "spots", BANDS * self.wide // 4 + 1)
        known = nodes.select("node", "weight", "bands", "bits", "units").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = spots.join(known, "node")
        # each node as a member of the bucket and, if lone, as that too; each in all pairs of blocks that its block is part of
        sides = F.when(F.col("lone"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
        rows = rows.withColumn("is_lone", F.explode(sides))
        n_own, n_other = (F.when(F.col("is_lone"), F.col(x)).otherwise(F.col(y)) for x, y in (("lone_blocks", "all_blocks"), ("all_blocks", "lone_blocks")))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), n_own).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_other - 1)))
        rows = rows.withColumns({"i": F.when(F.col("is_lone"), F.col("own")).otherwise(F.col("other")), "j": F.when(F.col("is_lone"), F.col("other")).otherwise(F.col("own"))})
        rows = rows.select("band", "bucket", "i", "j", "is_lone", "node", "root", "weight", "units", "bits", "bands")
        compare = possible_pairs(self.similarity, self.deviations, best_only)
        found = rows.groupBy("band", "bucket", "i", "j").applyInArrow(compare, "a binary, b binary, excess double")
        if best_only:
            found = found.groupBy("a").agg(F.min(F.struct("excess", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def table(self) -> DataFrame:
        """(id, class_id, class_size, n_copies) of each row: the class's least id, its rows, the rows of equal text."""
        found = self.rows.join(self.classes, "node").select("id", "class_id", "class_size", F.col("copies").alias("n_copies"))
        return found.withColumnRenamed("id", free_name(["class_id", "class_size", "n_copies"], self.id_col))

    def kept(self) -> DataFrame:
        """One row of each class, with all columns: the row of the least id (none only if all are null)."""
        columns = self.df.columns
        keep = self.classes.where(F.col("keep_node") == F.col("node")).select("class_id", "node")  # a row a class
        own, digest = free_name(columns, "own_digest"), F.unhex(F.md5(F.coalesce(F.col(self.text_col).cast("string"), F.lit("")).cast("binary")))
        keep = keep.toDF(free_name(columns, "keep_id"), free_name(columns, "keep_node"))
        rows = self.df.withColumn(own, digest)
        found = rows.join(keep, F.col(self.id_col).eqNullSafe(F.col(keep.columns[0]))).where(F.col(own) == F.col(keep.columns[1]))
        repeated = self.rows.groupBy("id", "node").count().where("count > 1")
        if not repeated.isEmpty():  # whole rows that are repeated leave one
            found = found.dropDuplicates([own])
        return found.select(*columns)


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, deviations: float | None = DEVIATIONS) -> DataFrame:
    """(id, class_id, class_size, n_copies) of each row of ``df``."""
    return Duplicates(df, id_col, text_col, similarity, deviations).table()


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, deviations: float | None = DEVIATIONS) -> DataFrame:
    """The rows of ``df``, one of each class."""
    return Duplicates(df, id_col, text_col, similarity, deviations).kept()
