"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

Base findings come from three fixed patterns.  Candidates are all maximal runs of
16 or more key characters that hold a letter and a digit, and the base findings
themselves.  Each candidate is scored with its surrounding context, a long one in
overlapping windows of which the highest counts, by a small
convolutional network in numpy: character groups, one convolution (a sum of
table rows, as the input is one-hot), max and mean pooling, a dense layer.  It is
trained on labelled findings of a bounded sample of documents, and on written
look-alikes of both kinds.  Secrets are the patterns' keys, framed as candidates
without the keyword that gave them away; negatives are long plain words, and mixed
runs only where a written rule says that they are words and numbers, since any
other may be a key that the patterns miss.  A half held out of the training
calibrates the score (Platt) and sets the threshold: the highest that keeps
``RECALL`` of the held-out secrets that no pattern finds.
Candidates over the threshold that no base finding covers are added as spans of
kind ``model``, also beside base findings inside them; base findings always stay.

Null and empty texts have no findings.  Rows are handled one by one, repeated
rows and ids are all kept.  Long texts are searched whole, in time in proportion to
their length.  Findings with the same start are listed in the order of their kinds.
An empty table trains on the look-alikes alone.  An id column named like a new column
gets a longer name; ``redact_secrets`` keeps all columns.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, parts_of

# The base patterns, in the order in which their kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_MIXED = re.compile(r"[A-Za-z][+/_=-]*[0-9]|[0-9][+/_=-]*[A-Za-z]")
#: Words, each perhaps with a short number behind it, and numbers, between separators: no key.
_HARMLESS = re.compile(r"[+/_=-]*(?:(?:[A-Z]?[a-z]{2,12}[0-9]{0,2}|v?[0-9]{1,4})(?:[+/_=-]+|$))+")

#: Bounds of the training sample (parameters of ``fitted``): documents read (about), labelled candidates of
#: either kind taken from them, negatives taken from one document.
SAMPLE_DOCUMENTS, SAMPLE_CANDIDATES, NEGATIVES_EACH = 20_000, 1_500, 3
#: Share of the held-out secrets that the threshold keeps.
RECALL = 0.98
BEFORE, INSIDE, AFTER = 20, 48, 8
#: Characters from one window of a long candidate to the next, windows scored at once.
STRIDE, SCORED = 16, 8192
LENGTH, WIDTH, FILTERS, DENSE = BEFORE + INSIDE + AFTER, 5, 16, 16


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' findings, in order; kind is a place in ``KINDS``."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Every maximal run of key characters, long enough, that mixes letters and digits."""
    return [(m.start(), m.end()) for m in RUN.finditer(text) if _MIXED.search(m[0])]


def harmless(run: str) -> bool:
    """Whether a run may stand as a negative: unmixed, or by the written rule."""
    return not _MIXED.search(run) or _HARMLESS.fullmatch(run) is not None


def keys(text: str) -> list[tuple[int, int, int]]:
    """(start of the finding, start, end) of the candidates that are the patterns' keys."""
    found = [(m.start(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(s, s, e) for s, k, e in base_findings(text) if k in (1, 2)]
    places = {}
    for f, s, e in found:
        for m in RUN.finditer(text, s, e):
            if _MIXED.search(m[0]):
                places.setdefault(m.span(), f)
    return [(f, s, e) for (s, e), f in places.items()]


def _groups() -> np.ndarray:
    """The group of each ASCII code and, last, of all others; 0 is padding."""
    own = {c: i for i, c in enumerate(" \n:=\"'/+-_.@,", start=12)}
    table = np.zeros(129, dtype=np.int64)
    for code in range(128):
        c = chr(code)
        if c in own:
            table[code] = own[c]
        elif c.isdigit():
            table[code] = 1
        elif c in "abcdef":
            table[code] = 2 + (c in "ae")
        elif c.islower():
            table[code] = 4 + (c in "iou") + 2 * (c in "tnsrhl")
        elif c in "ABCDEF":
            table[code] = 8
        elif c.isupper():
            table[code] = 9 + (c in "IOU")
        else:
            table[code] = 11
    table[128] = 25
    return table


GROUPS = _groups()
N_GROUPS = 26


def window(text: str, start: int, end: int) -> str:
    """At most ``INSIDE`` characters of a candidate at a fixed place, with what surrounds them."""
    end = min(end, start + INSIDE)
    before, inside = text[max(0, start - BEFORE) : start], text[start:end]
    return before.rjust(BEFORE, "\x00") + inside.ljust(INSIDE, "\x00") + text[end : end + AFTER].ljust(AFTER, "\x00")


def windows(text: str, start: int, end: int):
    """Overlapping windows over the whole candidate; the last one ends with it."""
    last = max(start, end - INSIDE)
    for at in range(start, last, STRIDE):
        yield window(text, at, end)
    yield window(text, last, end)


def _codes(windows: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, LENGTH)
    codes = GROUPS[np.minimum(points, 128)]
    codes[points == 0] = 0
    return codes


class CharCnn:
    """Convolution over character groups, max and mean pooling, one dense layer, a logit."""

    def __init__(self, seed: int = 11):
        rng = np.random.RandomState(seed)
        self.conv = (rng.randn(WIDTH, N_GROUPS, FILTERS) * 0.2).astype(np.float32)
        self.conv_bias = np.zeros(FILTERS, np.float32)
        self.dense = (rng.randn(2 * FILTERS, DENSE) * 0.2).astype(np.float32)
        self.dense_bias = np.zeros(DENSE, np.float32)
        self.out = (rng.randn(DENSE) * 0.2).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        #: Platt scaling of the logit, and the threshold on the probability.
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, codes):
        n = LENGTH - WIDTH + 1
        z = self.conv_bias + sum(self.conv[k][codes[:, k : k + n]] for k in range(WIDTH))
        a = np.maximum(z, 0)
        pooled = np.concatenate([a.max(axis=1), a.mean(axis=1)], axis=1)
        hidden = np.maximum(pooled @ self.dense + self.dense_bias, 0)
        return z, a, pooled, hidden, hidden @ self.out + self.out_bias

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[i : i + 512])[-1] for i in range(0, len(codes), 512)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def probabilities(self, windows: list[str]) -> np.ndarray:
        if len(windows) > SCORED:
            return np.concatenate([self.probabilities(windows[i : i + SCORED]) for i in range(0, len(windows), SCORED)])
        if not windows:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(_codes(windows)) + self.shift, -40, 40)))

    def train(self, codes: np.ndarray, labels: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 5) -> None:
        """Adam over the logistic loss."""
        rng, names = np.random.RandomState(seed), ("conv", "conv_bias", "dense", "dense_bias", "out", "out_bias")
        first, second, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
        n = LENGTH - WIDTH + 1
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for i in range(0, len(order), 64):
                rows = order[i : i + 64]
                x, y = codes[rows], labels[rows]
                z, a, pooled, hidden, logit = self._forward(x)
                d = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(rows)).astype(np.float32)
                g = {"out": hidden.T @ d, "out_bias": d.sum(keepdims=True)}
                dh = np.outer(d, self.out) * (hidden > 0)
                g |= {"dense": pooled.T @ dh, "dense_bias": dh.sum(axis=0)}
                dp = dh @ self.dense.T
                da = np.repeat(dp[:, None, FILTERS:] / n, n, axis=1)
                top = a.argmax(axis=1)
                b, f = np.indices(top.shape)
                da[b, top, f] += dp[:, :FILTERS]
                dz = da * (z > 0)
                flat = dz.reshape(-1, FILTERS)
                g["conv_bias"] = flat.sum(axis=0)
                g["conv"] = np.zeros_like(self.conv)
                for k in range(WIDTH):
                    np.add.at(g["conv"][k], x[:, k : k + n].reshape(-1), flat)
                step += 1
                for name in names:
                    first[name] = 0.9 * first[name] + 0.1 * g[name]
                    second[name] = 0.999 * second[name] + 0.001 * g[name] ** 2
                    move = rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, name, (getattr(self, name) - move).astype(np.float32))

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float = RECALL, counted: np.ndarray | None = None) -> None:
        """Platt scaling by Newton steps, then the highest threshold with at least ``recall`` of the (counted) secrets."""
        x, w = np.stack([self.logits(codes), np.ones(len(codes))], axis=1).astype(np.float64), np.array([1.0, 0.0])
        good = labels > 0.5
        target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (w - [1, 0]))
            w = w - np.clip(step, -2, 2)
        self.slope, self.shift = map(float, w)
        p = np.sort(1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))[good if counted is None else good & counted])
        self.threshold = float(p[int((1 - recall) * len(p))]) if len(p) else 0.5


def look_alikes(count: int = 400, seed: int = 3) -> list[tuple[str, int]]:
    """Written windows with labels: keys in the usual notations, and harmless runs that resemble them."""
    rng, found = random.Random(seed), []
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = ("0123456789abcdef", letters + letters.upper() + digits, letters + letters.upper() + digits + "+/", letters.upper() + digits, letters + digits)
    words = ["data", "model", "report", "page", "index", "version", "release", "chapter", "section", "table", "figure", "result", "image", "north", "river"]
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    plain = lambda: " ".join(some(letters, rng.randint(2, 9)) for _ in range(4))
    for _ in range(count):
        key = rng.choice(["", "", "", "ghp_", "sk-", "AKIA", "xoxb-"]) + some(rng.choice(alphabets), rng.randint(18, 64))
        lead = rng.choice([" ", " ", " key=", ' token = "', " secret: ", "\n", " Bearer "])
        path = lambda n: "".join(rng.choice(words) + rng.choice("//_-") for _ in range(n))
        if rng.random() < 0.3:  # a window of a long candidate: in front of the key stands a path
            lead = rng.choice([" ", "\n"]) + path(rng.randint(2, 6))
            key = path(rng.randint(0, 2))[-rng.randint(1, STRIDE) :] + key
        found.append((plain() + lead, key, rng.choice([" ", '" ', "\n", ", "]) + plain(), 1))
        dull = rng.choice([
            lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}",
            lambda: "-".join(rng.choice(words) for _ in range(4)) + f"-{rng.randint(1, 99)}",
            lambda: "/".join(rng.choice(words) for _ in range(3)) + f"/{rng.randint(1, 2030)}/",
            lambda: "_".join(rng.choice(words) for _ in range(3)) + f"_v{rng.randint(1, 9)}",
            lambda: "".join(rng.choice(words).title() for _ in range(4)) + str(rng.randint(1, 99)),
            lambda: rng.choice(words) * 4 + str(rng.randint(1, 999)),
            lambda: "=" * rng.randint(4, 12) + rng.choice(words) + str(rng.randint(1, 9)) + "=" * rng.randint(4, 12),
            lambda: rng.choice(letters) * rng.randint(16, 40) + rng.choice(digits),
        ])()
        lead = rng.choice([" ", "\n"])
        if rng.random() < 0.3:  # a window of a long path or joined name
            lead, dull = lead + path(rng.randint(2, 6)), path(rng.randint(2, 6)) + dull
            dull = dull[rng.randint(0, STRIDE) :]
        found.append((plain() + lead, dull.ljust(16, "-"), rng.choice([" ", "\n", ". "]) + plain(), 0))
    return [(window(a + b + c, len(a), len(a) + len(b)), y) for a, b, c, y in found]


class Reach:
    """How far sorted findings that start before a place reach; places are asked for in ascending order."""

    def __init__(self, findings):
        self.findings, self.at, self.end = findings, 0, -1

    def before(self, place: int) -> int:
        while self.at < len(self.findings) and self.findings[self.at][0] < place:
            self.end = max(self.end, self.findings[self.at][2])
            self.at += 1
        return self.end


def labelled_of(text: str, negatives: int = NEGATIVES_EACH) -> list[tuple[str, int]]:
    """Windows with labels out of one text: all its keys, and its first harmless runs."""
    # before a key stands what came before its keyword
    found = [(window(text[max(0, f - BEFORE) : f] + text[s : e + AFTER], min(f, BEFORE), min(f, BEFORE) + e - s), 1) for f, s, e in keys(text)]
    reach, left = Reach(base_findings(text)), negatives
    for m in RUN.finditer(text):
        if left <= 0:
            break
        if reach.before(m.end()) <= m.start() and harmless(m[0]):
            found.append((window(text, m.start(), m.end()), 0))
            left -= 1
    return found


def labelled_candidates(df: DataFrame, id_col: str, text_col: str, documents: int = SAMPLE_DOCUMENTS, most: int = SAMPLE_CANDIDATES, negatives: int = NEGATIVES_EACH) -> list[tuple[str, int]]:
    """Windows with labels out of a bounded sample of documents, chosen by a hash of the id."""

    def run(batches):
        for batch in parts_of(batches, 0):
            found = [x for text in batch.column(0).to_pylist() for x in labelled_of(text or "", negatives)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], ["window", "label"])

    rows = df.count()
    if not rows:
        return []
    # about ``documents`` rows, by a hash of the id; the limits below hold the bound exactly
    share = min(1.0, documents / rows)
    chosen = df.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < int(share * 1_000_000))
    found = chosen.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "window string, label int")
    found = found.groupBy("window").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("window"))
    # orderBy + limit: the driver gets ``most`` windows of fixed length of either kind at most; one job for both
    of = [found.where(F.col("label") == y).orderBy("order", "window").limit(most) for y in (0, 1)]
    return [(r["window"], r["label"]) for r in sorted(of[0].unionByName(of[1]).collect(), key=lambda r: (r["label"], r["order"], r["window"]))]


def fitted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = SAMPLE_DOCUMENTS, most: int = SAMPLE_CANDIDATES, negatives: int = NEGATIVES_EACH) -> CharCnn:
    """The network trained and calibrated on a bounded sample of ``df`` and the look-alikes."""
    labelled = labelled_candidates(df, id_col, text_col, documents, most, negatives) + look_alikes()
    codes, labels = _codes([w for w, _ in labelled]), np.array([y for _, y in labelled], dtype=np.float32)
    model, kept = CharCnn(), np.random.RandomState(7).permutation(len(labels)) % 2 == 0
    model.train(codes[kept], labels[kept])
    missed = np.array([not base_findings(w) for w, _ in labelled])
    model.calibrate(codes[~kept], labels[~kept], counted=missed[~kept])
    return model


def all_findings(texts: list[str], model: CharCnn) -> list[list[tuple[int, int, int]]]:
    """Base findings and the model's, in order, of each text."""
    found, places, waiting, scores = [], [], [], []

    def score():
        """The highest probability of each candidate among the windows that wait."""
        for p, n in zip(model.probabilities([w for w, _ in waiting]), [n for _, n in waiting]):
            scores[n] = max(scores[n], p)
        waiting.clear()

    for i, text in enumerate(texts):
        base = base_findings(text)
        found.append(base)
        reach = Reach(base)
        for start, end in candidates(text):
            if reach.before(start + 1) >= end:  # a base finding covers it
                continue
            scores.append(0.0)
            for w in windows(text, start, end):
                waiting.append((w, len(places)))
                if len(waiting) >= SCORED:
                    score()
            places.append((i, start, end))
    score()
    for p, (i, start, end) in zip(scores, places):
        if p >= model.threshold:
            found[i].append((start, 3, end))
    return [sorted(f) for f in found]


def joined(findings) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in findings)


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: CharCnn | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_model, base_sha256, spans) of each text."""
    kind, model = dict(df.dtypes)[id_col], model or fitted(df, id_col, text_col)
    names = ["id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"]

    def run(batches):
        for batch in parts_of(batches, 1):
            found = all_findings([t or "" for t in batch.column(1).to_pylist()], model)
            counts = [pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in range(4)]
            base = [hashlib.sha256(joined(x for x in f if x[1] < 3).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array([joined(f) for f in found], pa.string())], names)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", free_name(names[1:], id_col))


def redacted(text: str, findings) -> str:
    """The text with each finding replaced by a mark of its kind; findings that overlap share one."""
    out, at = [], 0
    for start, kind, end in findings:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: CharCnn | None = None) -> DataFrame:
    """``df`` with the findings in its text replaced by marks; null texts stay null, all columns stay."""
    model, columns = model or fitted(df, id_col, text_col), df.columns
    at = columns.index(text_col)

    def run(batches):
        for batch in parts_of(batches, at):
            texts = batch.column(at).to_pylist()
            found = all_findings([t or "" for t in texts], model)
            new = [t and redacted(t, f) for t, f in zip(texts, found)]
            arrays = list(batch.columns)
            arrays[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return df.mapInArrow(run, df.schema)
