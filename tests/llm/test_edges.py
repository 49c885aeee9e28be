"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import random

import pytest

import public_tokenizers
from qasidalake.llm import byte_bpe, fingerprints, licenses, near_duplicates, packing, preferences, quality_classifier, quality_rules, secrets, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, score double, m string, id string, kept boolean, weight int"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
random.seed(5)
WORDS = ["the", "of", "licence", "river", "stone", "a", "and", "mill", "water", "north", "gentle", "under", "bridge", "walk"]
PROSE = " ".join(random.choice(WORDS) + str(random.randint(0, 99)) * (random.random() < 0.3) for _ in range(400))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None, "x", 1.0, "m", "i", True, 3) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, PROSE, "en", "s"), (3, PROSE, "en", "s"), (None, PROSE + " end", None, "s"), (4, "x" * 200_000, "en", None), (5, (PROSE + "\n") * 60, "de", "s"), (6, " \t\n\r\x0b\x0c ", "fr", "s"), (7, "é 😀 İK mit license", "fr", "s")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (3, 1, 0), (3, 1, 1), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "fingerprints": lambda df, labels: fingerprints.document_fingerprints(df),
    "neighbours": lambda df, labels: fingerprints.neighbour_fingerprints(df),
    "quality scores": lambda df, labels: quality_classifier.quality_scores(df, labels),
    "secrets": lambda df, labels: secrets.secret_spans(df),
    "rules": lambda df, labels: quality_rules.quality_measures(df),
    "bpe": lambda df, labels: byte_bpe.round_trip_digests(df, RANKS, public_tokenizers.PATTERN),
    "licenses": lambda df, labels: licenses.license_labels(df),
    "classes": lambda df, labels: near_duplicates.near_duplicate_classes(df),
    "counts": lambda df, labels: token_counts.token_counts(df, RANKS),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(odd, none, labels, name):
    assert OPERATORS[name](odd, labels).count() == odd.count()
    assert OPERATORS[name](none, labels.limit(0)).count() == 0


@pytest.mark.parametrize("keep", [lambda df, y: quality_classifier.keep_good(df, y), lambda df, y: quality_rules.keep_good(df), lambda df, y: near_duplicates.without_near_duplicates(df), lambda df, y: secrets.redact_secrets(df)])
def test_stages_keep_columns(odd, none, labels, keep):
    found = keep(odd, labels)
    assert found.columns == odd.columns and 0 < found.count() <= odd.count()
    assert keep(none, labels.limit(0)).count() == 0


def test_classes_of_copies(odd):
    rows = near_duplicates.near_duplicate_classes(odd).collect()
    sizes = {r["doc_id"]: r["class_size"] for r in rows}
    assert sizes[3] == 3 and sizes[None] == 3  # two copies and a near copy
    assert sizes[1] == sizes[2] == 2  # null and empty
    assert near_duplicates.without_near_duplicates(odd).where("doc_id = 3").count() == 1


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack_documents(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] in (1, 2)) == 2
    assert packing.pack_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0
    for seed in range(20):
        sizes = [random.Random(seed).randint(1, 700) for _ in range(40)]
        windows = packing.windows_of(sizes, 1024)
        assert sorted(i for w in windows for i in w) == list(range(40)) and max(sum(sizes[i] for i in w) for w in windows) <= 1024


def test_long_pre_token():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    for text in ("".join(random.choice("abcdeé") for _ in range(50_000)), "  a  b\n\n  c\t d's 12 ", "<|endoftext|>", "  x\u0085y"):
        assert bpe.encode(text) == t.encode_ordinary(text) and bpe.decode(bpe.encode(text)) == text.encode()
        assert bpe.round_trip(text)[1] == text.encode()


def test_secret_model_generalises():
    from qasidalake.llm.secrets import CharCnn, _codes, look_alikes

    import numpy as np

    made = look_alikes(600, seed=41)
    codes, y = _codes([w for w, _ in made]), np.array([l for _, l in made], dtype=np.float32)
    model = CharCnn()
    model.train(codes[:800], y[:800])
    model.calibrate(codes[800:1000], y[800:1000])
    p = model.probabilities([w for w, _ in made[1000:]])
    caught = (p >= model.threshold)[y[1000:] > 0.5].mean()
    false = (p >= model.threshold)[y[1000:] < 0.5].mean()
    assert caught > 0.9 and false < 0.1


def test_redaction():
    text = 'x password="abcdefgh1" y AKIA' + "A" * 20 + " z"
    clean = secrets.redacted(text, secrets.base_findings(text))
    assert clean == 'x <assign>" y <access> z'


def test_classifier_on_held_out_rows(spark):
    from conftest import DATA

    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.select("doc_id", "quality").where("quality IS NOT NULL").dropDuplicates(["doc_id"])
    fit, test = known.where("doc_id % 3 <> 0"), known.where("doc_id % 3 = 0")
    rows = quality_classifier.quality_scores(docs, fit).join(test, "doc_id").select("score", "kept", "quality").collect()
    good, bad = ([r for r in rows if r["quality"] == y] for y in (1, 0))
    wins = sum((a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.9
    assert sum(r["kept"] for r in good) > 0.97 * len(good)


def test_preferences(spark):
    turn = "array<struct<role:string,text:string>>"
    rows = [
        (1, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c")]),
        (2, [("user", "a")], [("user", "a")]),
        (3, None, [("assistant", None)]),
        (4, [("user", None), (None, "x")], [("user", None)]),
        (5, [], []),
    ]
    found = {r["id"]: r for r in preferences.format_preferences(spark.createDataFrame(rows, f"id int, chosen {turn}, rejected {turn}")).collect()}
    assert found[1]["prompt"] == "<|user|>\na<|end|>\n" and found[1]["chosen_completion"] == "<|assistant|>\nb<|end|>\n"
    start, end = map(int, found[1]["chosen_mask"].split(":"))
    assert found[1]["chosen_completion"][start:end] == "b<|end|>\n"
    assert found[2]["chosen_completion"] == found[2]["rejected_completion"] == "" and found[2]["n_prompt_turns"] == 1
    assert found[3]["prompt"] == "" and found[3]["rejected_completion"] == "<|assistant|>\n<|end|>\n"
    assert found[4]["n_prompt_turns"] == 1 and found[5]["prompt"] == ""


def test_license_join_is_exact(spark):
    """Every line that holds the threshold's share of a template's words, found by counting."""
    rng, lines = random.Random(9), []
    for label, text in licenses.TEMPLATES:
        words = licenses.template_words(text)
        for _ in range(15):
            some = [w for w in words if rng.random() < 0.85] + [rng.choice(WORDS) for _ in range(rng.randint(0, 6))]
            rng.shuffle(some)
            lines.append(" ".join(some))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    found = {r["doc_id"]: r["labels"] for r in licenses.license_labels(df, rules={}).collect()}
    for i, line in enumerate(lines):
        own = set(line.split())
        wanted = {label for label, text in licenses.TEMPLATES if len(own & set(licenses.template_words(text))) >= licenses.needed(len(licenses.template_words(text)))}
        wanted |= {label for phrase, label in licenses.PHRASES if f" {phrase} " in f" {line} "}
        assert found[i] == ",".join(sorted(wanted))


def test_rules(spark):
    text = " ".join(f"the{i} of" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, "a b c " * 40), (3, "x\nx\ny #*")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality_rules.quality_measures(df).collect()}
    assert rows[1]["kept"] and not rows[1]["base_failed"] and rows[1]["n_repeat_words"] == 0
    assert rows[2]["n_repeat_words"] == 120 and rows[2]["base_failed"]
    assert (rows[3]["n_dup_lines"], rows[3]["n_symbols"], rows[3]["word_chars"]) == (1, 2, 5)


def test_wrapped_licenses(spark):
    """Notices broken into lines of 70 columns, bare and in comments, are found like whole ones."""
    import textwrap

    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one.",
        "apache": "Licensed to you (the \"Licensee\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
    }
    rows, wanted = [], []
    for label, text in notices.items():
        for mark in ("", " * ", "# "):
            rows.append("\n".join(["Some project", "", *(mark + line for line in textwrap.wrap(text, 70 - len(mark))), "", PROSE]))
            wanted.append((label, 1.0))
    rows.append("\n\n".join(["permission granted, free of charge", PROSE, "to any person obtaining a copy", PROSE, "of this software and associated documentation files is hereby"]))
    wanted.append(("", 0.0))  # the words are all there, but far apart
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_labels(df).collect()}
    assert [found[i] for i in range(len(rows))] == wanted


def _made_keys(rng, count):
    """Keys in the usual notations that no base pattern finds."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    some = lambda n, chars=letters: "".join(rng.choice(chars) for _ in range(n))
    found = [rng.choice([lambda: "ghp_" + some(36), lambda: "sk-" + some(48), lambda: some(40, letters + "+/")])() for _ in range(count)]
    return [k for k in found if secrets.candidates(k) and not secrets.base_findings(k)]


def test_secret_model_on_keys_without_keywords(spark):
    """Trained where such keys are common, it finds held-out ones; none of them is ever a negative."""
    rng = random.Random(21)
    bare, framed, held = (_made_keys(rng, n) for n in (900, 300, 300))
    prose = lambda: " ".join(rng.sample(WORDS, 6)) + " "
    dull = lambda: "/".join(rng.choice(["docs", "section", "river", "image", "chapter"]) for _ in range(4)) + f"/{rng.randint(1, 99)}"
    texts = [prose() + k + " " + prose() + dull() for k in bare] + [f'{prose()}token = "{k}" {prose()}' for k in framed]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labelled = secrets.labelled_candidates(df, "doc_id", "text")
    insides = {y: {w[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE].rstrip("\x00") for w, label in labelled if label == y} for y in (0, 1)}
    assert insides[0] and not insides[0] & {k[: secrets.INSIDE] for k in bare}
    assert insides[1] == {k[: secrets.INSIDE] for k in framed}  # framed as candidates
    model = secrets.fitted(df)
    marked = lambda xs: sum(any(k == 3 for _, k, _ in f) for f in secrets.all_findings([prose() + x + " " + prose() for x in xs], model)) / len(xs)
    assert marked(held) > 0.95 and marked([dull() for _ in range(300)]) < 0.1


def test_secret_threshold_keeps_recall():
    """Also where a hard secret's score lies under a half."""
    import numpy as np

    model, labels = secrets.CharCnn(), np.array([1.0] * 100 + [0.0] * 300)
    scores = np.concatenate([np.linspace(-3, 3, 100), np.linspace(-4, 1, 300)])
    model.logits = lambda codes: scores
    model.calibrate(np.zeros((400, secrets.LENGTH), dtype=np.int64), labels)
    p = 1 / (1 + np.exp(-(model.slope * scores + model.shift)))
    assert (p[:100] >= model.threshold - 1e-12).mean() >= secrets.RECALL and model.threshold < 0.5


def test_secrets_in_long_candidates():
    """Keys behind more than a window of path, and keys of which a pattern finds a part only."""
    import numpy as np

    labelled, rng = secrets.look_alikes(), random.Random(8)
    codes, y = secrets._codes([w for w, _ in labelled]), np.array([label for _, label in labelled], dtype=np.float32)
    model = secrets.CharCnn()
    model.train(codes[:400], y[:400])
    model.calibrate(codes[400:], y[400:])
    path = lambda n: "".join(rng.choice(["docs", "section", "river", "image", "chapter"]) + rng.choice("/_-") for _ in range(n))
    marked = lambda x: any(k == 3 and s <= 9 and e >= 9 + len(x) for s, k, e in secrets.all_findings([f"see this {x} and more"], model)[0])
    behind = [path(rng.randint(10, 40)) + k for k in _made_keys(rng, 200)]
    assert sum(map(marked, behind)) > 0.9 * len(behind)
    assert sum(marked(path(rng.randint(10, 15)) + str(rng.randint(1, 99))) for _ in range(200)) < 0.2 * 200
    parts = [a + rng.choice(["AKIA" + "Q7X2" * 4, "0123456789abcdef" * 2]) + "xQ9Z" + b for a, b in zip(_made_keys(rng, 100), _made_keys(rng, 100))]
    assert all(secrets.base_findings(x) for x in parts) and sum(map(marked, parts)) > 0.9 * len(parts)
    whole = 'token="' + "a1B2c3D4" * 6 + '"'
    assert [k for _, k, _ in secrets.all_findings([whole], model)[0]] == [0]  # covered by its base finding
    assert secrets.all_findings(["a1" * 500_000], model)[0] in ([], [(0, 3, 1_000_000)], secrets.base_findings("a1" * 500_000))


def test_packing_of_added_tokens(spark):
    """Ids as the tokenizer file gives them, also where a text holds its added token."""
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    token = "<|endoftext|>"
    texts = [f"a {token} b", token, token * 3, f"x{token}  y\n\n{token}\n", f"{token} the{token}end", "<|endoftext|", PROSE + token + PROSE, "<|endoftext |> a", ""]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).collect()
    for i, text in enumerate(texts):
        ids, at = t.encode(text, add_special_tokens=False).ids + [packing.END_ID], 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r["length"]
        assert at == len(ids)


def test_licenses_told_apart(spark):
    """Notices with nearly the words of a template, for other licenses."""
    others = [
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
        "This work is licensed under the GNU Free Documentation License, version 3.",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
    ]
    own = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by"}
    texts = [*others, *own, *own, None, "", PROSE + "\n" + "Licensed under CC\nBY-NC 4.0. " + PROSE]
    df = spark.createDataFrame(list(enumerate(texts)), "labels long, text string")
    found = {r["labels_"]: (r["labels"], r["score"]) for r in licenses.license_labels(df, "labels").collect()}
    assert [found[i] for i in range(len(others))] == [("", 0.0)] * len(others)
    assert [found[len(others) + i] for i in range(7)] == [*((x, 1.0) for x in [*own.values()] * 2), ("", 0.0), ("", 0.0), ("cc-by-nc", 1.0)]


@pytest.mark.parametrize("seed, n, fill", [(4, 60, []), (9, 150, sorted({w for _, bars in licenses.RULES.values() for w in bars}))])
def test_license_windows_by_brute_force(spark, seed, n, fill):
    """Every window and line of texts of template words in any order, without the filters; with words that rules bar among them, too."""
    rng, texts = random.Random(seed), []
    if fill:  # the only allowed window starts before the first template word
        texts.append("zz qq work licensed under a creative commons attribution 4 0 international license for commercial use")
    for _ in range(n):
        words = []
        for _ in range(3):
            _, text = rng.choice(licenses.TEMPLATES)
            words += [w for w in licenses.template_words(text) if rng.random() < 0.9] + rng.sample(WORDS, rng.randint(0, 4)) + rng.sample(fill, min(len(fill), rng.randint(0, 1)))
        texts.append("".join(w + rng.choice("  \n") for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_labels(df).collect()}
    for i, text in enumerate(texts):
        words, labels, best = text.split(), set(), 0.0
        for label, template in licenses.TEMPLATES:
            own, length = set(licenses.template_words(template)), licenses.template_length(template)
            musts, bars = licenses.RULES.get(label, ((), ()))
            musts = own & set(musts)
            blocks = [words[k : k + length] for k in range(len(words))] + [line.split() for line in text.split("\n")]
            for block in map(set, blocks):
                if len(own & block) >= licenses.needed(len(own)) and musts <= block and not block & set(bars):
                    labels.add(label)
                    best = max(best, len(own & block) / len(own))
        labels |= {label for phrase, label in licenses.PHRASES if f" {phrase} " in f" {' '.join(words)} "}
        assert found[i] == (",".join(sorted(labels)), pytest.approx(best))


def test_secret_spans_by_brute_force(spark):
    """Texts with many findings, against a plain loop over candidates, findings and windows."""
    rng, labelled = random.Random(6), secrets.look_alikes()
    import numpy as np

    codes, y = secrets._codes([w for w, _ in labelled]), np.array([label for _, label in labelled], dtype=np.float32)
    model = secrets.CharCnn()
    model.train(codes[:400], y[:400], epochs=4)
    model.calibrate(codes[400:], y[400:])
    texts = []
    for _ in range(12):
        parts = [rng.choice([*_made_keys(rng, 3), f'token = "{rng.getrandbits(80):x}"', "AKIA" + "B2" * 12, f"{rng.getrandbits(120):030x}", "docs/section/river/image/12"]) for _ in range(rng.randint(0, 40))]
        texts.append(rng.choice([" ", "\n", "/", "="]).join(parts))
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in secrets.secret_spans(df, model=model).collect()}
    for i, text in [*enumerate(texts), (99, "")]:
        base, wanted = secrets.base_findings(text), []
        for start, end in secrets.candidates(text):
            covered = any(s <= start and end <= e for s, _, e in base)
            if not covered and max(model.probabilities([w])[0] for w in secrets.windows(text, start, end)) >= model.threshold - 1e-9:
                wanted.append((start, 3, end))
        assert found[i]["spans"] == secrets.joined(sorted(base + wanted)) and found[i]["n_model"] == len(wanted)
    assert sum(r["n_model"] for r in found.values()) > 20


def test_secret_scan_takes_linear_time():
    import time

    model, text = secrets.CharCnn(), 'token="abcdefgh1" docs/section/river/image/12 '
    model.probabilities = lambda windows: [0.0] * len(windows)
    times = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        assert len(secrets.all_findings([text * n], model)[0]) == n
        times.append(time.perf_counter() - began)
    assert times[1] < 24 * times[0] + 0.2


def test_packing_without_fragments():
    """Windows are full, and about one piece a window is no whole tail."""
    rng, packer, sizes, out = random.Random(3), packing.Packer(0), [], []
    for doc in range(2_000):
        sizes.append(int(rng.lognormvariate(5.5, 1.2)) + 1)
        out += packer.add(doc, bytes(4 * sizes[-1]))
    out += packer.finish()
    fill, pieces = {}, {}
    for doc, start, length, _, total, sequence, _ in out:
        fill[sequence] = fill.get(sequence, 0) + length
        pieces.setdefault(doc, []).append((start, length))
        assert total == sizes[doc]
    assert all(sum(n for _, n in p) == sizes[d] for d, p in pieces.items())
    padding = sum(1024 - f for f in fill.values() if f & (f - 1))
    least = sum(-(-n // 1024) for n in sizes)  # pieces if no tail were cut
    assert padding < 0.005 * sum(sizes) and len(out) - least < 1.2 * len(fill)


def test_preferences_of_any_ids(spark):
    """Ids that cannot be counted on, rows without an id, pairs that are given."""
    swap = lambda kind, rows, pairs=None: {(r["conv_id"], str(r["chosen"][0]["text"])): [t["text"] for t in r["rejected"]] for r in preferences.answers_swapped(spark.createDataFrame(rows, f"conv_id {kind}, turn int, role string, text string"), pairs).collect()}
    two = lambda a, b: [(a, 1, "user", "q"), (a, 2, "assistant", "x"), (b, 1, "user", "q"), (b, 2, "assistant", "y")]
    assert swap("string", two("a", "b")) == {("a", "q"): ["q"], ("b", "q"): ["q"]}
    least = -(1 << 63)
    assert swap("long", two(least, least + 1)) == {(least, "q"): ["q", "y"], (least + 1, "q"): ["q"]}
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "conv_id string, other_id string")
    assert swap("string", two("a", "b"), pairs) == {("a", "q"): ["q", "y"], ("b", "q"): ["q", "x"]}
    alone = [(None, 1, "user", "p"), (None, 2, "assistant", "r"), (0, 1, "user", "s"), (0, 1, "assistant", None)]
    assert len(swap("long", alone)) == 3  # each row without an id is a conversation
    assert swap("long", []) == {}


def test_classifier_bounds_rows(spark):
    """Many rows of one id give one training row, and labels of both kinds count as bad."""
    rows = [(7, f"{PROSE} {i}", "en", "s") for i in range(200)] + [(i, PROSE[i:], "en", "s") for i in range(100, 140)]
    df = frame(spark, rows)
    marked = df.select(df.doc_id.alias("sample_id"), "*")
    from pyspark.sql import functions as F

    text, meta, y = quality_classifier._features(marked, "text", "lang", "source", F.lit(None).cast("int"))
    assert len(text) == len(meta) == len(y) == 41
    labels = spark.createDataFrame([(7, 1), (7, 0), *((i, i % 2) for i in range(100, 140))], "doc_id long, quality int")
    assert quality_classifier.quality_scores(df, labels).count() == len(rows)


def test_classifier_by_brute_force(spark):
    """The query's scores against the same training over plain lists: all unlabelled texts ranked in each round."""
    import __spark_entry__
    import duckdb
    import numpy as np
    from conftest import DATA

    qc, path = quality_classifier, DATA
    docs = duckdb.sql(f"SELECT doc_id, lang, source, text FROM '{path}/documents.parquet'").fetchall()
    labels = dict(duckdb.sql(f"SELECT doc_id, min(quality) FROM '{path}/labels.parquet' WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1").fetchall())
    rows = [(i, qc.text_features((t or "").encode()).tobytes() + qc.meta_features(lang, source, (t or "").encode()).tobytes()) for i, lang, source, t in docs]
    known = {}
    for i, f in rows:
        if i in labels:
            known[i] = min(f, known.get(i, f))
    assert len(set(labels.values())) == 2 and len(known) < len({i for i, _ in rows})
    pairs = sorted((f, labels[i]) for i, f in known.items())
    pool = sorted({qc.digest_of(f): f for i, f in rows if i not in labels}.items())

    def surest(models, given):
        views, out = qc.both_views(f for _, f in pool), []
        for k in (0, 1):
            by = qc.rank_logits(models[k], views[k])
            order = [j for j in sorted(range(len(pool)), key=lambda j: (-abs(by[j]), pool[j][0])) if abs(by[j]) > qc.SURE and pool[j][0] not in given[k]][: qc.PER_ROUND]
            out.append(([pool[j][0] for j in order], views[0][order], views[1][order], (by[order] > 0).astype(float)))
        return out

    model = qc.CoTrained(*qc.both_views(f for f, _ in pairs), np.array([y for _, y in pairs]), surest)
    score = model.scores(*qc.both_views(f for _, f in rows))[2]
    want = sorted((i, round(float(x), 5), bool(x >= model.threshold)) for (i, _), x in zip(rows, score))
    got = sorted((r["doc_id"], r["score"], r["kept"]) for r in __spark_entry__.queries()["op2_quality_classifier"](spark, path).collect())
    assert len(got) == len(want) == len(docs)
    for a, b in zip(got, want):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-4 and a[2] == b[2]


@pytest.mark.parametrize("deviations", [near_duplicates.DEVIATIONS, None])
def test_hot_bucket(spark, deviations):
    """One large group of near copies around a text, in more than one block, against all pairs."""
    import numpy as np
    from qasidalake.llm import shingles

    rng = random.Random(12)
    base = [rng.choice(WORDS) + str(rng.randint(0, 500)) for _ in range(300)]
    texts = []
    for i in range(420):
        words = list(base)
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(rng.sample(base, 200)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(df, deviations=deviations).collect()}
    idf = near_duplicates.inverse_frequencies(*near_duplicates.document_frequency_table(df, "text"))
    words, bounds = shingles.words_by_text([t.encode() for t in texts])
    sets = [near_duplicates.weighted_shingles(words[bounds[k] : bounds[k + 1]], idf) for k in range(len(texts))]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if top(a) != top(b) and near_duplicates.weighted_jaccard(*sets[a], *sets[b]) >= 0.8:
                root[max(top(a), top(b))] = min(top(a), top(b))
    wanted = [top(i) for i in range(len(texts))]
    assert len(set(wanted)) > 20 and np.mean([found[i] == wanted[i] for i in range(len(texts))]) >= 0.99


def test_tables_are_removed(spark, odd):
    """Only what the result is read from stays in the shared folder."""
    from pathlib import Path

    from qasidalake.llm.common import shared_folder

    near_duplicates.near_duplicate_classes(odd).count()
    folder = Path(shared_folder(spark).removeprefix("file:"))
    assert not any(folder.glob("near-duplicates-*/*"))
