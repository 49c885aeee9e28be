"""Search over lines or titles: coarse filter, exact pattern, spans, ranking, caps.

One job for all sources.  The coarse substring stands before the pattern in the
filter; both run in the JVM.  A row that several sources hold is found once for each
of the sources asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import strip_punct
from ..functions.text import tightness
from ..sources.corpus import Corpus, in_arabic_with_plain, lines_of
from ..sources.index import only_lines
from ..sources.layout import BySource
from ..sources.snapshots import written
from .boolean import Term, parse

CANDIDATE_CAP, RESULT_CAP = 8000, 5000
#: Up to this cap Spark keeps only the first rows of each source in every task before it shuffles them.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def simple_term(query: str) -> Term | None:
    """The whole query as one term, without groups; None if it has nothing to look for."""
    term = Term(query, groups=False)
    return None if term.pattern is None else term


def poem_sources(corpus: Corpus) -> DataFrame:
    """(poem_id, source_id): each poem's own source and those of its aliases, once each."""
    own = corpus.poem.select(F.col("id").alias("poem_id"), "source_id")
    return own.unionByName(corpus.poem_alias.select("poem_id", "source_id")).where("source_id IS NOT NULL").distinct()


def source_order(corpus: Corpus, names: list[str] | None = None) -> tuple[int, ...]:
    """The ids of the corpus's own sources in order of priority; of those named, where some are, in the order asked for.

    Names that the corpus does not have are left out; no name, or only such, means all.
    """
    known = {r["name"]: r["id"] for r in corpus.source.select("id", "name").orderBy(F.desc("id")).collect()}  # a row for each source
    return tuple(known[n] for n in names or () if n in known) or tuple(sorted(known.values()))


@dataclass(frozen=True)
class Ask:
    """What to search and how much to return; ``None`` for a cap is no cap, for sources all in the order of their ids.

    ``postings`` looks lines up by the rarest trigrams of the query before they are read, where the
    corpus has postings, every match holds three characters or more and a scan is not cheaper.
    """

    titles: bool = False
    poet: str | None = None
    sources: tuple[int, ...] | None = None
    candidate_cap: int | None = CANDIDATE_CAP
    result_cap: int | None = RESULT_CAP
    postings: bool = False


def _capped(rows: DataFrame, cap: int) -> DataFrame:
    spark = rows.sparkSession
    if int(spark.conf.get(GROUP_LIMIT)) < cap:
        spark.conf.set(GROUP_LIMIT, str(cap))
    nth = F.row_number().over(Window.partitionBy("source_rank").orderBy("row_id"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= cap)


def candidates_capped(rows: DataFrame, cap: int) -> DataFrame:
    """Of each source the ``cap`` rows of least id, dealt out again for the work that follows."""
    return _capped(rows, cap).repartition(rows.sparkSession.sparkContext.defaultParallelism, "row_id")


def _up_to(id: str, ids: DataFrame, cap: int) -> Column:
    """Whether the id of a row is not beyond the last that the cap lets through in any source, of ``ids`` (source_rank, row_id)."""
    last = _capped(ids, cap).agg(F.max("row_id").alias("last")).head()["last"]
    return F.col(id).isNull() | (F.col(id) <= F.lit(last).cast("long"))  # ids that are null come first


def up_to_cap(corpus: Corpus, term, held: DataFrame, cap: int) -> DataFrame:
    """The lines up to the last id that the cap on candidates lets through in any source, so all candidates and some more.

    Only ids are joined and compared for that.  Texts further on are not sent, and not read where files follow the ids.
    """
    ids = _near(corpus.lines.select("poem_id", F.col("id").alias("row_id"), "plain"), term).drop("plain")
    return corpus.lines.where(_up_to("id", ids.join(held, "poem_id").select("source_rank", "row_id"), cap))


def _named(rows: DataFrame, corpus: Corpus) -> DataFrame:
    poet = corpus.poet.select(F.col("id").alias("poet_id"), F.col("name").alias("poet"))
    return rows.join(poet, "poet_id", "left")


def _shown(corpus: Corpus, *own: str) -> DataFrame:
    shown = [F.coalesce("title", F.lit("")).alias("title"), F.coalesce("line_count", F.lit(0)).alias("line_count")]
    return corpus.poem.select(F.col("id").alias("poem_id"), "poet_id", *shown, *own)


def _texts(corpus: Corpus, titles: bool, *derived: str) -> DataFrame:
    """Titles or lines with what is shown of their poems; a row for each, whatever its sources."""
    if titles:
        texts = {"original": F.col("title"), "row_id": F.col("poem_id"), **{c: F.col(f"title_{c}") for c in derived}}
        return _shown(corpus, *(f"title_{c}" for c in derived)).withColumns(texts)
    lines = corpus.lines.select("poem_id", F.col("id").alias("row_id"), F.coalesce("line", F.lit("")).alias("original"), *derived)
    return lines.join(_shown(corpus), "poem_id")


def source_rows(corpus: Corpus, titles: bool = False) -> DataFrame:
    """Every title or line once for each of its sources, with all that a search shows, dealt out and in order; for ``sources.layout``.

    Texts that ``corpus`` has uncut meet their poems whole, dealt by poems, and are cut where they are then, so that a
    text is sent once.  Other rows are dealt by ranges of ids after they have met their poems.
    """
    columns = ["source_id", "row_id", "poem_id", "original", "title", "poet", "line_count"]
    if not titles and "text" in corpus.lines.columns:
        poems = _named(_shown(corpus), corpus).join(poem_sources(corpus), "poem_id")
        lines = lines_of(corpus.lines.join(poems, "poem_id"), "source_id", "title", "poet", "line_count").sortWithinPartitions("source_id", "id")
        return in_arabic_with_plain(lines).withColumnsRenamed({"id": "row_id", "line": "original"}).select(*columns, "plain")
    rows = _named(_texts(corpus, titles), corpus).join(poem_sources(corpus), "poem_id").select(*columns)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(tasks, "source_id", "row_id").sortWithinPartitions("source_id", "row_id")


def _matching(rows: DataFrame, term) -> DataFrame:
    """The rows that match, with their spans and what ranks them."""
    if term is not None:
        if "stripped" not in rows.columns:
            rows = rows.withColumn("stripped", strip_punct(F.col("original")))
        rows = rows.where(term.exact(F.col("stripped"))).withColumn("spans", term.spans(F.col("original"), F.col("stripped"), sure=True))
    else:
        rows = rows.withColumn("spans", F.array().cast("array<struct<start:int,end:int>>"))
    first = F.get("spans", F.lit(0))
    rows = rows.withColumns({"start": F.coalesce(first["start"], F.lit(-1)), "end": F.coalesce(first["end"], F.lit(-1))})
    return rows.withColumn("tightness", tightness(F.col("start"), F.col("end"), F.col("original")))


def ranked_matches(rows: DataFrame, term, ask: Ask) -> DataFrame:
    """Of rows with their sources those that match, capped and ranked; without a cap on candidates ``rows`` may be matched already."""
    if ask.candidate_cap is not None:
        rows = candidates_capped(rows, ask.candidate_cap)
    if "tightness" not in rows.columns:
        rows = _matching(rows, term)
    best = [F.col("source_rank"), F.col("tightness").desc(), F.col("row_id")]
    if ask.result_cap is None:
        ranked = rows.withColumn("rank", F.lit(None).cast("int"))
    else:  # the window sees result_cap rows at most
        ranked = rows.orderBy(*best).limit(ask.result_cap).withColumn("rank", F.row_number().over(Window.orderBy(*best)))
    own = ["poem_id"] if ask.titles else ["poem_id", F.col("row_id").alias("line_id")]
    return ranked.select(*own, "original", "start", "end", "spans", "title", F.coalesce("poet", F.lit("")).alias("poet"), "line_count", "source_id", "source_rank", "tightness", "rank")


def _near(rows: DataFrame, term) -> DataFrame:
    """The rows that the coarse filter lets through; none where there is nothing to look for."""
    if term is None:
        return rows.where(F.lit(False))
    coarse = term.coarse(F.col("plain"))
    return rows if coarse is None else rows.where(coarse)


def search(corpus: Corpus, query, ask: Ask = Ask()) -> DataFrame:
    """Ranked matches of a query: a string, or an expression that ``parse`` read.

    ``corpus`` has its derived columns.  Candidates are capped for each source in
    the order of their ids, before the pattern is applied; results by source, then
    tightness, then id.  Results without a cap have no rank.
    """
    term = simple_term(query) if isinstance(query, str) else query
    probes = term.drivers() if ask.postings and corpus.postings is not None and term is not None and not ask.titles else None
    found = corpus.postings.lines_with(probes) if probes else None
    if found is not None:
        corpus = replace(corpus, lines=only_lines(corpus.lines, found))
    held, ranks = poem_sources(corpus), F.col("source_id")
    if ask.sources is not None:
        ranks = F.coalesce(*(F.when(F.col("source_id") == s, F.lit(i)) for i, s in enumerate(ask.sources)), F.lit(None).cast("int"))
        held = held.where(F.col("source_id").isin(list(ask.sources)))
    held = held.withColumn("source_rank", ranks)
    if ask.poet is not None:
        corpus = replace(corpus, poet=corpus.poet.where(F.col("name") == ask.poet))
    if ask.candidate_cap is not None and found is None and term is not None and not ask.titles:
        shown = corpus.poem.select(F.col("id").alias("poem_id"), "poet_id")
        if ask.poet is not None:
            shown = shown.join(corpus.poet.select(F.col("id").alias("poet_id")), "poet_id", "left_semi")
        corpus = replace(corpus, lines=up_to_cap(corpus, term, held.join(shown, "poem_id"), ask.candidate_cap))
    if ask.candidate_cap is None and not ask.titles:  # once a line and before the joins, which then send no text that nobody asks for
        lines = corpus.lines.withColumn("original", F.coalesce("line", F.lit("")))
        corpus = replace(corpus, lines=_matching(_near(lines, term), term).drop("original"))
        rows = _texts(corpus, False, "spans", "start", "end", "tightness")
    else:
        rows = _near(_texts(corpus, ask.titles, "plain", "stripped"), term)
    rows = _named(rows, corpus)
    if ask.poet is not None:
        rows = rows.where("poet IS NOT NULL")
    return ranked_matches(rows.join(held, "poem_id"), term, ask)


def search_staged(stored: BySource, query, ask: Ask = Ask(), seen=None) -> DataFrame:
    """The rows of ``search``, a source at a time; once the cap on results is full the other sources are not read.

    ``stored`` is the layout that ``sources.layout`` writes.  A stage reads the partition of one source and joins nothing;
    its last candidate is found by the ids alone, so that no task sends more rows than candidates, whatever the tasks.
    Its results, capped by what is left, are written before the next begins; ``seen(source_id, found)`` hears of each
    stage.  Sources asked for twice count where they come first.  Without a cap on results there is nothing to stop
    for, which is an error.
    """
    if ask.result_cap is None:
        raise ValueError("a search without a cap on results reads all sources: use search")
    term = simple_term(query) if isinstance(query, str) else query
    rows = _near(stored.titles if ask.titles else stored.lines, term)
    rows = rows if ask.poet is None else rows.where(F.col("poet") == ask.poet)
    ranks = {s: s for s in stored.sources} if ask.sources is None else {s: i for i, s in reversed(list(enumerate(ask.sources)))}
    left, stages = ask.result_cap, []
    for source, rank in sorted(ranks.items(), key=lambda item: item[1]):
        if left <= 0 or term is None:
            break
        own = rows.where(F.col("source_id") == source).withColumn("source_rank", F.lit(rank))
        if ask.candidate_cap is not None:
            own = own.where(_up_to("row_id", own.select("source_rank", "row_id"), ask.candidate_cap))
        stage = written(ranked_matches(own, term, replace(ask, result_cap=left)), "search-stage")
        found = stage.count()
        stages.append(stage.withColumn("rank", F.col("rank") + (ask.result_cap - left)))
        left -= found
        if seen is not None:
            seen(source, found)
    if not stages:
        return ranked_matches(rows.where(F.lit(False)).withColumn("source_rank", F.lit(0)), term, ask)
    return reduce(DataFrame.unionByName, stages)


def search_lines(corpus: Corpus, query: str, **ask) -> DataFrame:
    return search(corpus, query, Ask(**ask))


def search_titles(corpus: Corpus, query: str, **ask) -> DataFrame:
    return search(corpus, query, Ask(titles=True, **ask))


def search_lines_boolean(corpus: Corpus, expression: str, **ask) -> DataFrame:
    return search(corpus, parse(expression), Ask(**ask))


def search_titles_boolean(corpus: Corpus, expression: str, **ask) -> DataFrame:
    return search(corpus, parse(expression), Ask(titles=True, **ask))


def search_entries(rows: DataFrame, query: str, text_col: str = "original") -> DataFrame:
    """The rows whose text matches, with start and end: for small lists such as poets' names."""
    from ..functions.text import strip_all, strip_punct

    term = simple_term(query)
    wild = any(c in query for c in "*?؟_")
    if term is None or not (wild or term.probe.text):
        return rows.where(F.lit(False)).withColumns({"start": F.lit(None).cast("int"), "end": F.lit(None).cast("int")})
    stripped = strip_punct(F.col(text_col))
    found = rows if wild else rows.where(strip_all(F.col(text_col)).contains(term.probe.text))
    found = found.withColumn("span", term.span(F.col(text_col), stripped)).where(F.col("span").isNotNull())
    return found.withColumns({"start": F.col("span.start"), "end": F.col("span.end")}).drop("span")
