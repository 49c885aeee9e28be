"""Quality classifier by co-training on two views.

The text view describes the content: shares of character kinds and of pairs of
kinds, hashed word beginnings and endings, repetition.  The metadata view
describes the page: language, source, length, line layout.  Each view has a
logistic regression.  Both start from the labelled rows.  In each round either
view labels the ``PER_ROUND`` unlabelled rows that it is most sure of, out of all, those
go to the other view's training rows, and both are fitted again.  Platt scaling on
held-out labelled rows calibrates each view; a logistic regression over both calibrated
log-odds, fitted on the same held-out rows, scores all documents.

Training starts from at most ``labelled`` labelled rows, chosen by a hash of their ids,
one row for each id.  The features of all rows are written once; rows of equal features
count once among the unlabelled ones, ties go to the lower digest of the features.  Scoring
reads every whole text.  A document is rejected under ``threshold``, the highest that
keeps ``keep`` of the good rows held out for it, and never over 0.5; where few of them
say so, a calibrated score under ``LEAST`` is rejected in any case.

Null texts count as empty, a null language or source is a value of its own.  An id
with labels of both kinds counts as bad; of several rows of one id the one with the
least features is trained on.  Without labels of both kinds every score is 1.
Repeated rows are all kept, long texts are read whole.  An empty table gives an empty
result; ``keep_good`` keeps all columns, an id named like a new column gets a longer name.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, parts_of, written

#: Labelled rows that are trained on at most; a parameter of ``fitted``.
LABELLED = 6_000
#: Rows that either view labels in a round at most, and the log-odds that it must exceed for each.
ROUNDS, PER_ROUND, SURE = 4, 200, 2.0
#: Share of the held-out good rows that the threshold keeps.
KEEP = 0.995
#: Scores that are rejected however few good rows are held out.
LEAST = 0.005
KINDS, HASHED, META_HASHED = 16, 64, 48


def _kind_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            table[b] = 15
        elif c in "aeiou":
            table[b] = 0
        elif c.islower():
            table[b] = 1
        elif c.isupper():
            table[b] = 2
        elif c.isdigit():
            table[b] = 3
        elif c in " \t":
            table[b] = 4
        elif c in "\n\r":
            table[b] = 5
        elif c in ".,;":
            table[b] = 6
        elif c in "!?":
            table[b] = 7
        elif c in "#*":
            table[b] = 8
        elif c in "$%&":
            table[b] = 9
        elif c in "|<>":
            table[b] = 10
        elif c in "'\"":
            table[b] = 11
        elif c in "()[]{}":
            table[b] = 12
        elif c in "-_/=+:@":
            table[b] = 13
        else:
            table[b] = 14
    return table


_KIND = _kind_table()
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
TEXT_SIZE = KINDS + KINDS * KINDS + HASHED + 4
META_SIZE = META_HASHED + 8


def text_features(data: bytes, block: int = 1 << 20) -> np.ndarray:
    """The text view of a whole text."""
    out, n = np.zeros(TEXT_SIZE, np.float32), len(data)
    if not n:
        out[-1] = 1
        return out
    single, pairs, last = np.zeros(KINDS), np.zeros(KINDS * KINDS), None
    for lo in range(0, n, block):
        kinds = _KIND[np.frombuffer(data[lo : lo + block], dtype=np.uint8)]
        single += np.bincount(kinds, minlength=KINDS)
        pairs += np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
        if last is not None:
            pairs[last * KINDS + kinds[0]] += 1
        last = kinds[-1]
    out[:KINDS] = single / n
    out[KINDS : KINDS + KINDS * KINDS] = np.sqrt(pairs / n)
    words = data.split()
    if words:
        distinct = set(words)
        hashed = np.bincount([hash_of(w[:2] + b"|" + w[-2:]) for w in distinct], minlength=HASHED)
        out[KINDS + KINDS * KINDS : -4] = hashed / len(distinct)
        out[-4] = len(distinct) / len(words)
        out[-3] = math.log1p(len(words)) / 10
        out[-2] = len(max(distinct, key=len)) ** 0.5 / 10
    return out


def hash_of(data: bytes, size: int = HASHED) -> int:
    return zlib.crc32(data) % size


def meta_features(lang, source, data: bytes) -> np.ndarray:
    """The metadata view: language, source, length and line layout."""
    out = np.zeros(META_SIZE, np.float32)
    out[hash_of(b"l" + (lang or "\0").encode(), META_HASHED)] = 1
    out[hash_of(b"s" + (source or "\0").encode(), META_HASHED)] = 1
    size, lines = len(data), data.split(b"\n")
    lengths = np.array([len(x) for x in lines], dtype=np.float64)
    distinct = len(set(lines))
    out[META_HASHED:] = (
        math.log1p(size) / 12,
        (math.log1p(size) / 12) ** 2,
        math.log1p(len(lines)) / 8,
        math.log1p(lengths.mean()) / 10,
        math.log1p(lengths.max()) / 12,
        lengths.std() / (1 + lengths.mean()),
        distinct / len(lines),
        float((lengths == 0).mean()),
    )
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """Logistic regression with balanced classes, standardised inputs and an L2 penalty, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0):
        x = np.asarray(x, np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        share = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y < 0.5).sum())) * len(y)
        w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
        ridge[-1] = 1e-3
        for _ in range(12):
            p = _sigmoid(x @ w)
            hessian = (x.T * (share * np.maximum(p * (1 - p), 1e-4))) @ x + np.diag(ridge)
            step = np.linalg.solve(hessian, x.T @ (share * (p - y)) + ridge * w)
            w = w - step
            if np.abs(step).max() < 1e-4:
                break
        self.w = w

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((np.asarray(x, np.float64) - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)


def platt(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make the logits calibrated on held-out rows."""
    x, w, good = np.stack([logits, np.ones(len(y))], axis=1), np.array([1.0, 0.0]), y > 0.5
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    for _ in range(30):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(2), x.T @ (p - target) + 1e-2 * (w - [1, 0]))
        w = w - np.clip(step, -1, 1)
    return float(w[0]), float(w[1])


class CoTrained:
    """Both views, calibrated and combined."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, surest, keep: float = KEEP):
        """``y`` labels the rows of ``text`` and ``meta``.

        ``surest(models, given)``: for each view the digests of the unlabelled rows that it is most sure of and that
        ``given`` (a set for each view) does not name, their text and metadata features, and their guessed labels.
        """
        self.constant = len(np.unique(y)) < 2
        if self.constant:
            self.threshold = 0.0
            return
        held = np.random.RandomState(17).permutation(len(y)) % 3 == 0
        if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
            held = np.zeros(len(y), bool)
        fit = ~held
        views, given = (text, meta), (set(), set())
        rows, labels = [v[fit] for v in views], [y[fit].astype(float)] * 2
        models = [Logistic(rows[k], labels[k]) for k in (0, 1)]
        for _ in range(ROUNDS):
            for k, (digests, *more, guess) in enumerate(surest(models, given)):  # view k labels for the other one
                other = 1 - k
                given[k].update(digests)
                rows[other] = np.vstack([rows[other], more[other]])
                labels[other] = np.concatenate([labels[other], guess])
            models = [Logistic(rows[k], labels[k]) for k in (0, 1)]
        self.models, test = models, held if held.any() else fit
        # calibration and joint model on one half of the held-out rows, the threshold on the other
        half = np.random.RandomState(19).permutation(len(y)) % 2 == 0
        calibrating, judging = test & half, test & ~half
        if len(np.unique(y[calibrating])) < 2 or not (y[judging] > 0.5).any():
            calibrating = judging = test
        logits = [models[k].logits(views[k][calibrating]) for k in (0, 1)]
        self.calibration = [platt(logit, y[calibrating]) for logit in logits]
        both = np.stack([s * x + b for x, (s, b) in zip(logits, self.calibration)], axis=1)
        self.joint = Logistic(both, y[calibrating], penalty=0.1)
        good = np.sort(self.scores(text[judging], meta[judging])[2][y[judging] > 0.5])
        self.threshold = float(min(0.5, max(LEAST, good[int((1 - keep) * len(good))])))

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: by text, by metadata, by both."""
        if self.constant:
            return (np.ones(len(text)),) * 3
        both = [s * m.logits(v) + b for m, v, (s, b) in zip(self.models, (text, meta), self.calibration)]
        return _sigmoid(both[0]), _sigmoid(both[1]), _sigmoid(self.joint.logits(np.stack(both, axis=1)))


def digest_of(features: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(features, digest_size=8).digest(), "big", signed=True)


def both_views(features) -> tuple[np.ndarray, np.ndarray]:
    """Text and metadata features of rows of bytes."""
    table = np.frombuffer(b"".join(features), np.float32).reshape(-1, TEXT_SIZE + META_SIZE)
    return table[:, :TEXT_SIZE], table[:, TEXT_SIZE:]


def _vectors(df: DataFrame, text_col: str, lang_col: str, source_col: str, id_col: str, label) -> DataFrame:
    """(id, sample_id, digest, features, label) of every row: the id as it is and as a string; the features are bytes."""

    def run(batches):
        for batch in parts_of(batches, 2):
            lang, source, text, y, own = (c.to_pylist() for c in batch.columns[:5])
            found = [text_features(t or b"").tobytes() + meta_features(a, s, t or b"").tobytes() for a, s, t in zip(lang, source, text)]
            arrays = [batch.column(5), pa.array(own, pa.string()), pa.array([digest_of(f) for f in found], pa.int64()), pa.array(found, pa.binary()), pa.array(y, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "sample_id", "digest", "features", "label"])

    held = (F.col(lang_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col).cast("string").cast("binary"), label, F.col(id_col).cast("string"), F.col(id_col))
    rows = df.select(*(c.alias(name) for c, name in zip(held, ("lang", "source", "text", "label", "sample_id", "id"))))
    return rows.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, sample_id string, digest long, features binary, label int")


def _gathered(vectors: DataFrame) -> tuple:
    """Features and labels of a bounded set of ids, one row for each, on the driver."""
    rows = vectors.groupBy("sample_id").agg(F.min("features").alias("features"), F.min("label").alias("label"))
    found = sorted((bytes(r["features"]), r["label"]) for r in rows.collect())
    return *both_views(f for f, _ in found), np.array([0 if y is None else y for _, y in found])


def _features(df: DataFrame, text_col: str, lang_col: str, source_col: str, label) -> tuple:
    """Features and labels of rows with a bounded set of ``sample_id``, one row for each, on the driver."""
    return _gathered(_vectors(df, text_col, lang_col, source_col, "sample_id", label))


def rank_logits(model: Logistic, view: np.ndarray) -> np.ndarray:
    """Log-odds as rows are ranked by them: rounded, so that the order does not depend on how rows are dealt."""
    return np.round(model.logits(view), 6)


def _surest(vectors: DataFrame, marked: DataFrame):
    """``surest`` of ``CoTrained`` over all rows of ``vectors`` whose id is not in ``marked``; only the chosen come to the driver."""

    def surest(models, given):
        def run(batches):
            for batch in batches:
                by = [pa.array(rank_logits(m, v)) for m, v in zip(models, both_views(batch.column("features").to_pylist()))]
                yield pa.RecordBatch.from_arrays([batch.column("sample_id"), batch.column("digest"), *by], ["sample_id", "digest", "by0", "by1"])

        sure = vectors.mapInArrow(run, "sample_id string, digest long, by0 double, by1 double").where(f"greatest(abs(by0), abs(by1)) > {SURE}")
        sure = sure.join(marked.select("sample_id"), "sample_id", "left_anti").groupBy("digest").agg(F.min("by0").alias("by0"), F.min("by1").alias("by1"))
        # those given before are among the first as well, at most
        tops = [sure.select(F.lit(k).alias("view"), "digest", F.col(f"by{k}").alias("by")).where(f"abs(by) > {SURE}").orderBy(F.abs("by").desc(), "digest").limit(PER_ROUND + len(given[k])) for k in (0, 1)]
        ranked = sorted(tops[0].unionByName(tops[1]).collect(), key=lambda r: (-abs(r["by"]), r["digest"]))
        chosen = [[r for r in ranked if r["view"] == k and r["digest"] not in given[k]][:PER_ROUND] for k in (0, 1)]
        digests = sorted({r["digest"] for rows in chosen for r in rows})
        rows = vectors.where(F.col("digest").isin(digests)).groupBy("digest").agg(F.min("features").alias("features")) if digests else vectors.limit(0)
        features = {r["digest"]: bytes(r["features"]) for r in rows.collect()}
        return [([r["digest"] for r in rows], *both_views(features[r["digest"]] for r in rows), np.array([float(r["by"] > 0) for r in rows])) for rows in chosen]

    return surest


def _stored(df: DataFrame, scratch: Scratch, text_col: str, lang_col: str, source_col: str, id_col: str) -> DataFrame:
    """``_vectors`` of all rows, written."""
    return scratch.written(_vectors(df, text_col, lang_col, source_col, id_col, F.lit(None).cast("int")), "vectors")


def _fitted(vectors: DataFrame, labels: DataFrame, id_col: str, label_col: str, labelled: int, keep: float) -> CoTrained:
    marked = labels.select(F.col(id_col).cast("string").alias("sample_id"), F.col(label_col).cast("int").alias("sample_label")).where("sample_label IS NOT NULL AND sample_id IS NOT NULL")
    marked = marked.groupBy("sample_id").agg(F.min("sample_label").alias("sample_label"))
    turn = F.xxhash64("sample_id", F.lit(29))
    some = [marked.where(F.col("sample_label") == y).withColumn("turn", turn).orderBy("turn", "sample_id").limit(labelled // 2).drop("turn") for y in (0, 1)]
    known = vectors.join(F.broadcast(some[0].unionByName(some[1])), "sample_id")
    text, meta, y = _gathered(known.select("sample_id", "features", F.col("sample_label").alias("label")))
    return CoTrained(text, meta, y, _surest(vectors, marked), keep)


def fitted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality", labelled: int = LABELLED, keep: float = KEEP) -> CoTrained:
    """The classifier trained on a bounded sample of ``labels`` (id, 0 or 1) and on what it is most sure of among all other rows of ``df``."""
    scratch = Scratch(df.sparkSession, "quality-features")
    try:
        return _fitted(_stored(df, scratch, text_col, lang_col, source_col, id_col), labels, id_col, label_col, labelled, keep)
    finally:
        scratch.clear()


def _kept_rows(df: DataFrame, model: CoTrained, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The rows that are not rejected, with all columns."""
    columns = df.columns
    at = [columns.index(c) for c in (text_col, lang_col, source_col)]

    def run(batches):
        for batch in parts_of(batches, at[0]):
            text, lang, source = (batch.column(i).to_pylist() for i in at)
            text = [(t or "").encode() for t in text]
            if text:
                meta = np.array([meta_features(a and str(a), s and str(s), t) for a, s, t in zip(lang, source, text)])
                score = model.scores(np.array([text_features(t) for t in text]), meta)[2]
                yield batch.filter(pa.array(score >= model.threshold))

    return df.mapInArrow(run, df.schema)


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality") -> DataFrame:
    """(id, p_text, p_meta, score, kept) of every row, from the features that the training stored."""
    scratch, names = Scratch(df.sparkSession, "quality-features"), ["p_text", "p_meta", "score", "kept"]
    try:
        vectors = _stored(df, scratch, text_col, lang_col, source_col, id_col)
        model = _fitted(vectors, labels, id_col, label_col, LABELLED, KEEP)

        def run(batches):
            for batch in batches:
                scores = model.scores(*both_views(batch.column("features").to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, scores), pa.array(scores[2] >= model.threshold)], ["id", *names])

        found = vectors.select("id", "features").mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, p_text double, p_meta double, score double, kept boolean")
        found = written(found, "quality-scores")
    finally:
        scratch.clear()
    return found.withColumnRenamed("id", free_name(names, id_col))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality") -> DataFrame:
    """The rows of ``df`` that are not rejected, with all its columns."""
    return _kept_rows(df, fitted(df, labels, id_col, text_col, lang_col, source_col, label_col), text_col, lang_col, source_col)
