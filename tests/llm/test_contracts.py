"""The registered queries against plain brute force, or against their SQL."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import DATA, same_rows

import public_tokenizers
from qasidalake.llm import fingerprints, near_duplicates, shingles
from qasidalake.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_against_sql(spark, duck, name):
    assert same_rows(QUERIES[name](spark, DATA), duck, ORACLE_SQL[name]) > 0


def test_op1_edits_and_neighbours(spark, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op1_document_fingerprints"](spark, DATA).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for i, doc_id in enumerate(ids):
        own, after, r = texts[doc_id], texts[ids[(i + 1) % len(ids)]], rows[doc_id]
        k = len(own) // 2
        edited = own[: len(own) - k] + after[:k]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == sha(edited.encode())
        assert r["fingerprint"] == fingerprints.digest(own.encode()) and r["edited_fingerprint"] == fingerprints.digest(edited.encode())
        assert r["near_edited"] == pytest.approx(fingerprints.likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(fingerprints.likeness(r["fingerprint"], rows[ids[(i + 1) % len(ids)]]["fingerprint"]))
    assert sum(r["near_edited"] > r["near_next"] for r in rows.values()) > 0.9 * len(rows)


def test_op3_base_findings(spark):
    data = DATA.replace("0.001", "0.01")  # the smallest table holds no secrets
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    kinds = (
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    names, seen = ("assign", "access", "hex"), 0
    for r in QUERIES["op3_secret_scans"](spark, data).collect():
        found = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in p.finditer(texts[r["doc_id"]]) if ok(m))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in found) for k in range(3)]
        base = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in found)
        assert r["base_sha256"] == sha(base.encode())
        spans = r["spans"].split(",")
        assert [s for s in spans if s and not s.startswith("model")] == [b for b in base.split(",") if b]
        seen += len(found)
    assert seen > 0


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def packing_holds(rows, texts):
    t, pieces, sequences = tokenizer(), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    total = 0
    for doc_id, text in texts.items():
        ids, at = t.encode(text, add_special_tokens=False).ids + [0], 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            part = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += r["length"]
        assert at == len(ids)
        total += at
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    return padded / total


def test_op5_packing(spark, texts):
    assert packing_holds(QUERIES["op5_packing"](spark, DATA).collect(), texts) < 0.01


def test_op6_byte_bpe(spark, texts):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = QUERIES["op6_byte_bpe"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = t.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()))
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]].encode())


def test_op9_classes(spark, texts):
    """Classes against all pairs: nothing alike is apart, nothing together is unlike all its class."""
    rows = {r["doc_id"]: r for r in QUERIES["op9_minhash_near_dedup"](spark, DATA).collect()}
    assert sorted(rows) == sorted(texts)
    ids = sorted(texts)
    words, bounds = shingles.words_by_text([texts[i].encode() for i in ids])
    counts = Counter()
    for k in range(len(ids)):
        counts.update(set((words[bounds[k] : bounds[k + 1]] & 0xFFFF).tolist()))
    import numpy as np

    table = np.zeros(near_duplicates.FREQUENCY_BUCKETS, np.int64)
    for bucket, n in counts.items():
        table[bucket] = n
    idf = near_duplicates.inverse_frequencies(table, len(ids))
    sets = [near_duplicates.weighted_shingles(words[bounds[k] : bounds[k + 1]], idf) for k in range(len(ids))]
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if texts[ids[a]] == texts[ids[b]] or near_duplicates.weighted_jaccard(*sets[a], *sets[b]) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    wanted = {ids[i]: ids[root(i)] for i in range(len(ids))}
    found = {i: rows[i]["class_id"] for i in ids}
    assert sum(wanted[i] != found[i] for i in ids) <= 0.01 * len(ids)  # sampling may miss a pair near 0.8
    assert all(r["class_size"] == sum(found[j] == found[i] for j in ids) for i, r in rows.items())


def test_op10_counts(spark, texts):
    import base64

    tokens = [base64.b64decode(line.split()[0]) for line in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")]
    starts, rests = {t for t in tokens if t[:1] == b" "}, {t for t in tokens if t[:1] != b" "}
    longest = max(map(len, tokens))

    def greedy(word):
        at, n, word = 0, 0, b" " + word
        while at < len(word):
            pieces = rests if at else starts
            size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
            if not size:
                return 1
            at, n = at + size, n + 1
        return n

    for r in QUERIES["op10_token_counts"](spark, DATA).collect():
        words = texts[r["doc_id"]].encode().split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(map(greedy, words)))


def test_pipeline(spark, texts):
    """Each stage by its own operator, and the last against the tokenizer."""
    import corpus_pipeline
    from qasidalake.llm import secrets
    from qasidalake.llm.common import written

    docs, columns = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/documents.parquet").columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DATA), "test-stage")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert len(texts) > sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(not secrets.base_findings(t) for t in left.values())
    packing_holds(corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect(), left)
    assert {r["doc_id"] for r in QUERIES_AND_PIPELINE()["pipeline"](spark, DATA).select("doc_id").distinct().collect()} == set(left)


def QUERIES_AND_PIPELINE():
    import __spark_entry__

    return __spark_entry__.queries()


def test_pipeline_stages_by_brute_force(spark):
    """What the rules and the near-duplicate stage keep of their own input, counted and compared in plain Python."""
    import corpus_pipeline
    from qasidalake.llm.common import written
    from qasidalake.llm.quality_rules import STOP_WORDS

    stages = dict(corpus_pipeline.STAGES)
    docs = written(stages["quality classifier"](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA), "test-stage")

    def passes(text):
        words, lines = re.findall(r"[^ \t-\r]+", text), [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        n, chars = len(words), sum(map(len, words))
        if n < 50 or 100 * len(repeated) > 50 * n:
            return False
        share = sum(w.lower() in STOP_WORDS for w in words) / n
        return 1.5 <= chars / n <= 25 and len(re.findall("[#*$%&|<>]", text)) / n <= 0.5 and share >= 0.02 and (len(lines) - len(set(lines))) / len(lines) <= 0.6 and max(map(len, words)) <= 20_000

    kept = written(stages["quality rules"](spark, docs, DATA), "test-stage")
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect() if passes(r["text"] or "")}

    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    ids = sorted(texts)
    idf = near_duplicates.inverse_frequencies(*near_duplicates.document_frequency_table(kept, "text"))
    words, bounds = shingles.words_by_text([texts[i].encode() for i in ids])
    sets = [near_duplicates.weighted_shingles(words[bounds[k] : bounds[k + 1]], idf) for k in range(len(ids))]
    links, seen, least = defaultdict(set), set(), set()
    for a in range(len(ids)):
        for b in range(a):
            if texts[ids[a]] == texts[ids[b]] or near_duplicates.weighted_jaccard(*sets[a], *sets[b]) >= 0.8:
                links[a].add(b)
                links[b].add(a)
    for i in range(len(ids)):
        if i not in seen:  # the first of a class that is met has its least id
            least.add(ids[i])
            waiting = [i]
            while waiting:
                k = waiting.pop()
                if k not in seen:
                    seen.add(k)
                    waiting += links[k]
    single = {r["doc_id"] for r in stages["near-duplicates"](spark, kept, DATA).collect()}
    assert len(least) < len(ids) and len(single ^ least) <= 0.01 * len(ids)  # sampling may miss a pair near 0.8


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline
    from qasidalake.llm.common import written

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DATA), "test-stage")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == 0
