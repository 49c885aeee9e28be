"""Duplicate readings, migration and batches of imports, on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from qasidalake.operators import poem_dedup
from qasidalake.sources import corpus as C

FATHA, KASRA, SHADDA = MARKS = "َ", "ِ", "ّ"


def poems(spark, texts):
    """A corpus of poems (text, source_id), numbered from 0."""
    none = {name: spark.createDataFrame([], schema) for name, schema in C.SCHEMAS.items()}
    rows = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(texts)], "id long, source_id int")
    lines = [(i * 100 + k, i, line, k + 1, "") for i, (text, _) in enumerate(texts) for k, line in enumerate(text.split("\n"))]
    return C.Corpus(**{**none, "poem": none["poem"].unionByName(rows, allowMissingColumns=True), "lines": spark.createDataFrame(lines, C.SCHEMAS["lines"])})


def by_pairs(texts):
    """id -> survivor by comparing all pairs, one poem after the other."""

    def spots(text):
        found = set()
        for n, line in enumerate(text.split("\n")):
            place = -1
            for c in line:
                if c not in MARKS:
                    place += 1
                elif place >= 0:
                    found.add((n, place, c))
        return found

    bare = lambda text: "".join(c for c in text if c not in MARKS)
    order = sorted(range(len(texts)), key=lambda i: (-sum(c in MARKS for c in texts[i][0]), 99 if texts[i][1] is None else texts[i][1], i))
    kept, gone = [], {}
    for i in order:
        above = [j for j in kept if bare(texts[j][0]) == bare(texts[i][0]) and spots(texts[j][0]) >= spots(texts[i][0])]
        if above:
            gone[i] = above[0]
        else:
            kept.append(i)
    return gone


def test_readings_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(poem_dedup, "BLOCK", 16)  # so that a token's holders lie in several blocks
    pick, texts = random.Random(5), []
    for _ in range(260):
        letters = pick.choice(["بتثج\nحخد", "بتثجحخ", "سش\n\nصض"])
        marks = lambda: "".join(pick.sample([FATHA, KASRA, SHADDA], pick.choice([0, 0, 1, 1, 2])))
        text = pick.choice(["", "", FATHA]) + "".join(c if c == "\n" else c + marks() for c in letters)
        texts.append((text, pick.choice([0, 1, 2, None])))
    texts += [("بتثجحخ", 1), ("بتثجحخ", 0), ("ب" + FATHA * 2 + "تثجحخ", 0), ("ب" + FATHA + "تثجحخ", 0), ("", 1), ("", 0)] + texts[:20]
    got = {r["id"]: r["survivor"] for r in poem_dedup.duplicates(poems(spark, texts)).collect()}
    wanted = by_pairs(texts)
    assert not {i: (texts[i], got.get(i), wanted.get(i)) for i in got.keys() | wanted if got.get(i) != wanted.get(i)}
    assert len(wanted) > 40 and len(texts) - len(wanted) > 40


def test_chain_of_readings_needs_a_comparison_each(spark, monkeypatch):
    """Ever fuller readings of one poem: all go to the fullest, and none is compared with a second holder."""
    n, seen = 1500, {}
    texts = [("".join("ب" + (FATHA if k < i else "") for k in range(n // 10)) + "\n" + "".join("ت" + (FATHA if k < i // 10 else "") for k in range(n // 10)), 0) for i in range(n)]
    texts = [(t, s) for t, s in dict.fromkeys(texts)]
    plain = poem_dedup.written
    monkeypatch.setattr(poem_dedup, "written", lambda df, tag: seen.setdefault(tag, plain(df, tag)))
    got = {r["id"]: r["survivor"] for r in poem_dedup.duplicates(poems(spark, texts)).collect()}
    assert got == {i: len(texts) - 1 for i in range(len(texts) - 1)}
    assert seen["readings-tried"].count() < len(texts) and seen["readings-tried"].where("NOT whole").count() == 0


def flat(spark, rows):
    return spark.createDataFrame(rows, "id long, poet string, book string, type string, title string, page string, line_count int, source_url string")


def test_migration(spark, tmp_path):
    from qasidalake.operators import migration
    from qasidalake.sources.curation import Refused, read_stored

    first, second = C.SOURCES[0][2], C.SOURCES[1][2]
    rows = [(1, "زيد", "", None, "t", None, 2, first + "7"), (2, "عمرو", "b", "k", "t", "p", 1, second.upper() + "7"), (3, None, "a", "k", None, None, None, first + "8")]
    lines = spark.createDataFrame([(1, 1, "x", 1, ""), (2, 2, "y", 1, "")], C.SCHEMAS["lines"])
    migration.migrated(flat(spark, rows), lines, str(tmp_path / "ok"))
    found = read_stored(spark, str(tmp_path / "ok"))
    got = found.poem.select("id", "poet_id", "book_id", "type_id", "source_id", "source_url").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 1, None, None, 0, "7"), (2, 2, 2, 1, 1, "7"), (3, None, 1, 1, 0, "8")]
    assert {n: getattr(found, n).count() for n in ("poet", "book", "type", "source", "poem_alias", "lines")} == {"poet": 2, "book": 2, "type": 1, "source": 4, "poem_alias": 0, "lines": 2}
    assert [r["url_prefix"] for r in found.source.orderBy("id").collect()] == [p for _, _, p in C.SOURCES]
    with pytest.raises(Refused, match="there already"):
        migration.migrated(found.poem, lines, str(tmp_path / "ok"))
    with pytest.raises(Refused, match="url_prefix"):
        migration.source_urls(found.source)

    def refused(rows, name, **how):
        with pytest.raises(Refused) as e:
            migration.migrated(flat(spark, rows), lines, str(tmp_path / name), **how)
        assert not [p for p in (tmp_path / name).iterdir() if p.name.isdigit() or p.name.startswith("data")]  # nothing counts, nothing is left
        return e.value.broken

    strange = [(4, "x", None, None, None, None, 1, "ftp://7"), (5, "x", None, None, None, None, 1, None), (None, "x", None, None, None, None, 1, first + "9")]
    assert refused(rows + strange[:2], "unknown") == {"poem.source_id": 2}
    same = [(6, "x", None, None, None, None, 1, first + "7"), (7, "x", None, None, None, None, 1, first + "7")]
    assert refused(rows + same, "same") == {"source_url": 1}
    with pytest.raises(Exception, match="without a value|poem.id"):
        migration.migrated(flat(spark, rows + strange[2:]), lines, str(tmp_path / "noid"))
    some = [migration.Rule("line_count", F.col("line_count").isNull())]
    assert refused(rows, "counts", checks=some) == {"line_count": 1}
    migration.migrated(flat(spark, rows), lines, str(tmp_path / "one"), [migration.Rule("line_count", F.col("line_count").isNull(), most=1)])
    migration.migrated(flat(spark, rows).limit(0), lines.limit(0), str(tmp_path / "none"), [])
    assert read_stored(spark, str(tmp_path / "none")).poem.count() == 0


def test_batches_go_on_after_the_last(spark, tmp_path):
    from qasidalake.operators.schema_etl import imported, imported_in_batches
    from qasidalake.sources.batches import in_batches
    from qasidalake.sources.snapshots import Snapshots

    ids = [None, -5, 0, 3, 3, *range(10, 60), 10**12]
    raw = spark.createDataFrame([(i, f"p{n % 3}", f"a{n}\nb") for n, i in enumerate(ids)], "id long, poet_name string, text string").repartition(3)
    folder, seen = str(tmp_path / "b"), []

    def stop(done, total):
        seen.append((done, total))
        if done == 2:
            raise KeyError("stop")

    with pytest.raises(KeyError):
        imported_in_batches(raw, folder, 10, stop)
    first = Snapshots(spark, folder).latest()[1]["done"]
    bad = lambda part: {**imported(part), "poem": imported(part)["poem"].withColumn("title", F.raise_error(F.lit("broken")))}
    with pytest.raises(Exception, match="broken"):
        in_batches(raw, folder, bad, batch=10)
    assert Snapshots(spark, folder).latest()[1]["done"] == first  # what fails leaves nothing
    new = imported_in_batches(raw, folder, 10)
    assert Snapshots(spark, folder).latest()[1]["done"][:2] == first and seen[:2] == [(1, seen[0][1]), (2, seen[0][1])] and 4 <= seen[0][1] <= 8
    rows = lambda df: sorted(map(str, df.collect()))
    whole = imported(raw)
    assert all(rows(new[name].select(whole[name].columns)) == rows(whole[name]) for name in whole)
    assert in_batches(raw, folder, imported, batch=10) == 0
    later = raw.unionByName(spark.createDataFrame([(10**12 + 1, "p", "new")], raw.schema))
    assert in_batches(later, folder, imported, batch=10) == 1
    assert imported_in_batches(later, folder)["lines"].count() == whole["lines"].count() + 1
    none = imported_in_batches(raw.limit(0), str(tmp_path / "none"))
    assert none["poem"].count() == none["lines"].count() == 0
    nameless = spark.createDataFrame([(None, "p", "a"), (None, "p", "b")], raw.schema)
    assert imported_in_batches(nameless, str(tmp_path / "nameless"))["lines"].count() == 2
