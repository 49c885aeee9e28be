"""The tables of a verse corpus, read from Parquet or derived from plain documents."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import search_columns, translated, translated_and_plain, translated_digest
from ..functions.text import first_half
from .snapshots import written

if TYPE_CHECKING:
    from .index import Postings

# The sources of a corpus in order of priority, a place being the source_id.
SOURCES = (
    (0, "موسوعة أم القرى", "https://uqu.edu.sa/App/Poetry/Poems/"),
    (1, "الموسوعة الشعرية", "https://poetry.dct.gov.ae/poems/"),
    (2, "الديوان", "https://www.aldiwan.net/"),
    (3, "موسوعة آل مكتوم", None),
)

SCHEMAS = {
    "poem": "id long, poet_id long, source_url string, title string, page string, line_count int, book_id long, type_id long, source_id int",
    "lines": "id long, poem_id long, line string, line_number int, line_type string",
    "poet": "id long, name string",
    "book": "id long, name string",
    "type": "id long, name string",
    "source": "id int, name string, url_prefix string",
    "poem_alias": "id long, poem_id long, source_url string, source_id int, poet string, book string, page string, type string",
}


@dataclass(frozen=True)
class Corpus:
    poem: DataFrame
    lines: DataFrame
    poet: DataFrame
    book: DataFrame
    type: DataFrame
    source: DataFrame
    poem_alias: DataFrame
    #: The blocks of trigrams, where the corpus is stored with its index.
    postings: Postings | None = None
    #: Whether lines come by ids in tasks of about one size, so that a store need neither deal them out nor sort them.
    in_ranges: bool = False

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}


def source_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, SCHEMAS["source"])


def read_corpus(spark: SparkSession, folder: str) -> Corpus:
    """The corpus in ``folder``, a Parquet table each; sources and aliases may be missing."""
    found = {}
    for name in SCHEMAS:
        try:
            found[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) or name not in ("source", "poem_alias"):
                raise
            found[name] = source_table(spark) if name == "source" else spark.createDataFrame([], SCHEMAS[name])
    return Corpus(**found)


def write_corpus(corpus: Corpus, folder: str, lean: bool = False) -> None:
    """All tables as Parquet; ``lean`` leaves out the derived columns."""
    for name, table in corpus.tables().items():
        if lean:
            table = table.drop("plain", "stripped", "title_plain", "title_stripped")
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def with_derived(lines: DataFrame) -> DataFrame:
    """Lines with ``plain`` (the coarse key) and ``stripped`` (what patterns run on)."""
    both = lines.withColumn("derived", search_columns(F.coalesce("line", F.lit(""))))
    return both.withColumns({"plain": F.col("derived.plain"), "stripped": F.col("derived.stripped")}).drop("derived")


def with_titles(corpus: Corpus) -> Corpus:
    """Poems with the same columns of their titles, and a line count where they have none."""
    blank, poem = corpus.poem.where("line_count IS NULL").select(F.col("id").alias("poem_id")), corpus.poem
    if not blank.isEmpty():  # else the lines need not be read
        counts = corpus.lines.join(blank, "poem_id", "left_semi").groupBy(F.col("poem_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("counted"))
        poem = poem.join(counts, "id", "left").withColumn("line_count", F.coalesce("line_count", "counted", F.lit(0)).cast("int")).drop("counted")
    poem = poem.withColumn("derived", search_columns(F.coalesce("title", F.lit(""))))
    return replace(corpus, poem=poem.withColumns({"title_plain": F.col("derived.plain"), "title_stripped": F.col("derived.stripped")}).drop("derived"))


def build_index(corpus: Corpus) -> Corpus:
    """The corpus with its derived columns; running it again changes nothing."""
    return replace(with_titles(corpus), lines=with_derived(corpus.lines))


#: Places in a poem that ids of lines leave room for; lines further on have negative ids.
PLACES = 100_000


def line_id(poem_id: Column, place: Column) -> Column:
    """The id of a line, for ids of poems from 0 to 2**32 - 1 and places from 0 to 2**31 - 1; none is given twice."""
    return F.when(place < PLACES, poem_id * PLACES + place).otherwise(-(poem_id * (1 << 31) + place))


def trigrams(lines: DataFrame) -> DataFrame:
    """(gram, line_id) postings of ``plain``, once each: an index for a store that can look grams up."""
    grams = F.when(F.length("plain") >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("plain") - 2), lambda i: F.substring("plain", i, F.lit(3)))))
    return lines.select(F.explode(grams).alias("gram"), F.col("id").alias("line_id"))


# Latin letters of a plain document and the Arabic characters that stand for them.
LATIN = "abcdefghijklmnopqrstuvwxyzAOUéèêàùôîçäöüßñáíóú#|"
ARABIC = "".join(
    map(
        chr,
        [
            *(0x627, 0x628, 0x62A, 0x62F, 0x647, 0x641, 0x63A, 0x62D, 0x64A, 0x62C, 0x643, 0x644, 0x645, 0x646, 0x648, 0x642, 0x631, 0x633),
            *(0x634, 0x637, 0x62B, 0x639, 0x62E, 0x636, 0x649, 0x621),
            *(0x623, 0x624, 0x626),
            *(0x64E, 0x650, 0x64F, 0x64B, 0x64C, 0x64D, 0x652, 0x651, 0x670),
            *(0x64E, 0x64F, 0x651, 0x650, 0x64B, 0x652, 0x64F, 0x64C),
            *(0x640, 0x3D),
        ],
    )
)


def arabic(text: Column) -> Column:
    return F.translate(text, LATIN, ARABIC)


def _without_copies(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of poems: those of ``docs`` (doc_id, own, poem_id) whose ids are not their poem's go.

    What leaves the texts are ids alone, so that Spark sends these to the texts where they are few.  Only where rows of
    one id stay and go, the hash of the text (``own``) tells them apart.
    """
    goes = F.col("doc_id") != F.col("poem_id")
    ids = docs.groupBy("doc_id").agg(F.max(goes).alias("goes"), F.max(~goes).alias("stays")).where("goes").drop("goes")
    ids = written(ids, "corpus-copies")
    both = docs.where(goes).join(ids.where("stays").select("doc_id"), "doc_id", "left_semi").select("doc_id", "own")
    texts = texts.where("doc_id IS NOT NULL").join(ids.where("NOT stays").select("doc_id"), "doc_id", "left_anti")
    if ids.where("stays").isEmpty():
        return texts
    return texts.withColumn("own", F.xxhash64("text")).join(written(both, "corpus-copies"), ["doc_id", "own"], "left_anti").drop("own")


def lines_of(texts: DataFrame, *more: str) -> DataFrame:
    """The lines of the texts (poem_id, text) of poems, each with the columns ``more``, in the letters that these have."""
    cut = texts.select("poem_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"), *more)
    return cut.select(
        line_id(F.col("poem_id"), F.col("pos")).alias("id"),
        "poem_id",
        "line",
        (F.col("pos") + 1).alias("line_number"),
        F.lit("").alias("line_type"),
        *more,
    )


def in_arabic_with_plain(lines: DataFrame) -> DataFrame:
    """Lines in plain letters put in Arabic ones, with ``plain``.  Lines are smaller batches than their texts."""
    both = lines.withColumn("both", translated_and_plain(F.col("line"), LATIN, ARABIC))
    return both.withColumns({"line": F.col("both.text"), "plain": F.col("both.plain")}).drop("both")


def corpus_of_documents(spark: SparkSession, documents: DataFrame, stored: bool = False, texts_kept: bool = True, cut: bool = True) -> Corpus:
    """A corpus out of plain documents (doc_id, text, lang, source), in Arabic letters.

    Documents of equal text are one poem, that of the least id; the others are its aliases.  ``stored`` writes what
    the tables share: a row of few bytes for each document, and the texts of poems, dealt by ranges of ids.  Without
    ``texts_kept`` these are not written but made where lines are asked for, which suits whoever reads lines once or never.
    Without ``cut`` there are texts (poem_id, text) in place of lines, in plain letters, for whoever joins them before ``lines_of``.
    """
    texts = documents.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    # letters are put in one for one and line feeds stay, so that all but the lines comes out of the plain texts
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n")))
    title = first_half(arabic(F.substring_index("text", "\n", 1)))
    docs = texts.withColumns({"digest": translated_digest(F.col("text"), LATIN, ARABIC), "title": title, "line_count": feeds + 1, "own": F.xxhash64("text")})
    if stored:
        docs = written(docs.drop("text"), "corpus-digests")
    docs = docs.join(docs.groupBy("digest").agg(F.min("doc_id").alias("poem_id")), "digest")
    if stored:
        docs = written(docs.drop("digest"), "corpus-documents")
        texts = _without_copies(texts.select("doc_id", "text"), docs)
    else:
        texts = docs.where("doc_id = poem_id").select("doc_id", "text")
    if stored and cut:
        # a file may be one row group, and files may come in any order
        texts = texts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id")
    texts = texts.select(F.col("doc_id").alias("poem_id"), "text")
    if cut:
        texts = texts.withColumn("text", translated(F.col("text"), LATIN, ARABIC))
        texts = lines_of(written(texts, "corpus-texts") if stored and texts_kept else texts)
    poems = docs.where("doc_id = poem_id")
    poet = poems.select("source").where("source IS NOT NULL").distinct().select(F.dense_rank().over(_by("source")).cast("long").alias("id"), arabic("source").alias("name"), "source")
    kind = poems.select("lang").where("lang IS NOT NULL").distinct().select(F.dense_rank().over(_by("lang")).cast("long").alias("id"), F.col("lang").alias("name"))
    source_id = F.pmod(F.col("doc_id"), F.lit(4)).cast("int")
    url = F.concat(F.lit("p"), F.col("doc_id").cast("string"))
    poem = poems.join(poet, "source", "left").join(kind.select(F.col("id").alias("type_id"), F.col("name").alias("lang")), "lang", "left")
    poem = poem.select(
        F.col("doc_id").alias("id"),
        poet["id"].alias("poet_id"),
        url.alias("source_url"),
        "title",
        F.lit(None).cast("string").alias("page"),
        "line_count",
        F.lit(None).cast("long").alias("book_id"),
        "type_id",
        source_id.alias("source_id"),
    )
    none = [F.lit(None).cast("string").alias(c) for c in ("poet", "book", "page", "type")]
    alias = docs.where("doc_id <> poem_id").select(F.col("doc_id").alias("id"), "poem_id", url.alias("source_url"), source_id.alias("source_id"), *none)
    empty = spark.createDataFrame([], T.StructType.fromDDL(SCHEMAS["book"]))
    return Corpus(poem, texts, poet.select("id", "name"), empty, kind, source_table(spark), alias, in_ranges=stored and cut)


def _by(column: str):
    """Order over a dimension of a few names."""
    from pyspark.sql import Window

    return Window.orderBy(column)
