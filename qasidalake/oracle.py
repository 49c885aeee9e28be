"""DuckDB SQL for the registered queries of the verse engine, over the same derived corpus."""

from __future__ import annotations

from .functions.text import ALEF_GROUP, FOLD_FROM, FOLD_TO, LETTERS, MARKS, PUNCTUATION, SPACES, TATWEEL, YA_GROUP
from .sources.corpus import ARABIC, LATIN, SOURCES

_MARK, _EDGE = f"[{MARKS}]*", f"{LETTERS}{MARKS}"


def arabic(x: str) -> str:
    return f"translate({x}, '{LATIN}', '{ARABIC}')"


def strip_punct(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, '{TATWEEL}', ''), '[{PUNCTUATION}{SPACES}]+', ' ', 'g'))"


def strip_all(x: str) -> str:
    return f"translate(trim(regexp_replace(regexp_replace({x}, '[{TATWEEL}{MARKS}]', '', 'g'), '[{PUNCTUATION}{SPACES}]+', ' ', 'g')), '{FOLD_FROM}', '{FOLD_TO}')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, '{TATWEEL}', ''), '[ \t\n\r]+', ' ', 'g'))"


def bare(x: str) -> str:
    return f"regexp_replace({x}, '[{MARKS}]', '', 'g')"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def first_half(x: str) -> str:
    return trimmed(f"CASE WHEN instr({x}, '=') > 0 THEN substr({x}, 1, instr({x}, '=') - 1) ELSE {x} END")


_SOURCES = ", ".join(f"({i}, '{name}', {'NULL' if url is None else repr(url)})" for i, name, url in SOURCES)

#: The corpus that ``corpus_of_documents`` derives.
CORPUS = f"""WITH docs AS (SELECT doc_id, lang, source, {arabic("coalesce(text, '')")} AS text FROM documents),
linked AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS poem_id FROM docs),
poems AS (SELECT * FROM linked WHERE doc_id = poem_id),
poet AS (SELECT dense_rank() OVER (ORDER BY source) AS id, {arabic("source")} AS name, source FROM (SELECT DISTINCT source FROM poems WHERE source IS NOT NULL)),
kind AS (SELECT dense_rank() OVER (ORDER BY lang) AS id, lang AS name FROM (SELECT DISTINCT lang FROM poems WHERE lang IS NOT NULL)),
src(id, name, url_prefix) AS (VALUES {_SOURCES}),
poem AS (
  SELECT doc_id AS id, poet.id AS poet_id, 'p' || doc_id AS source_url, {first_half("string_split(text, chr(10))[1]")} AS title,
    len(string_split(text, chr(10)))::INT AS line_count, kind.id AS type_id, (doc_id % 4)::INT AS source_id
  FROM poems LEFT JOIN poet USING (source) LEFT JOIN kind ON kind.name = lang),
lines AS (
  SELECT doc_id * 100000 + pos AS id, doc_id AS poem_id, line, (pos + 1)::INT AS line_number
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM poems)),
alias AS (SELECT doc_id AS id, poem_id, 'p' || doc_id AS source_url, (doc_id % 4)::INT AS source_id FROM linked WHERE doc_id <> poem_id),
held AS (SELECT id AS poem_id, source_id FROM poem UNION SELECT poem_id, source_id FROM alias)
"""


def letters(word: str, exact: bool = False) -> str:
    """The pattern of plain letters with any marks; a space stands for white space."""
    out = ""
    for c in word:
        group = None if exact else next((g for g in (YA_GROUP, ALEF_GROUP) if c in g), None)
        out += " " if c == " " else (f"[{group}]" if group else c) + _MARK
    return out


ANY = f"[{LETTERS}]{_MARK}"
STAR = f"[{_EDGE}]*?"
BRIDGE = f"(?:(?:{ANY})+(?: (?:{ANY})+)* )?"


def matches(core: str) -> str:
    return f"regexp_matches(stripped, '(?:^|[^{_EDGE}])(?:{core})(?:$|[^{_EDGE}])')"


def found(core: str, coarse: str, where: str = "true", titles: bool = False, poet: str | None = None, sources=(0, 1, 2, 3), candidates: int = 8000, results: int = 5000) -> str:
    """CTEs that end in ``found``: the ranked matches, with the span of ``core``."""
    order = ", ".join(f"({s}, {i})" for i, s in enumerate(sources))
    pattern = f"'^(.*?(?:^|[^{_EDGE}]))({core})(?:$|[^{_EDGE}])'"
    if titles:
        rows = "SELECT id AS row_id, id AS poem_id, title AS original FROM poem"
    else:
        rows = "SELECT id AS row_id, poem_id, line AS original FROM lines"
    return f"""{CORPUS},
texts AS (SELECT *, {strip_all("original")} AS plain, {strip_punct("original")} AS stripped FROM ({rows})),
wanted(source_id, source_rank) AS (VALUES {order}),
near AS (
  SELECT texts.*, title, poet.name AS poet, line_count, source_id, source_rank,
    row_number() OVER (PARTITION BY source_rank ORDER BY row_id) AS nth
  FROM texts JOIN (SELECT id AS poem_id, title, poet_id, line_count FROM poem) USING (poem_id)
    LEFT JOIN poet ON poet.id = poet_id JOIN held USING (poem_id) JOIN wanted USING (source_id)
  WHERE {coarse} {f"AND poet.name = '{poet}'" if poet else ""}),
hits AS (
  SELECT *, length(regexp_extract(stripped, {pattern}, 1)) AS lead, length(regexp_extract(stripped, {pattern}, 2)) AS n
  FROM near WHERE nth <= {candidates} AND {matches(core)} AND {where}),
chars AS (
  SELECT row_id, pos, regexp_matches(substr(original, pos, 1), '[{PUNCTUATION}{SPACES}]') AS blank
  FROM (SELECT row_id, original, unnest(range(1, length(original) + 1)) AS pos FROM (SELECT DISTINCT row_id, original FROM hits))
  WHERE substr(original, pos, 1) <> '{TATWEEL}'),
kept AS (
  SELECT row_id, list(pos ORDER BY pos) AS places
  FROM (SELECT *, lag(blank, 1, true) OVER (PARTITION BY row_id ORDER BY pos) AS before FROM chars)
  WHERE NOT blank OR NOT before GROUP BY row_id),
spans AS (SELECT hits.*, (places[lead + 1] - 1)::INT AS start, places[lead + n]::INT AS "end" FROM hits JOIN kept USING (row_id)),
tight AS (SELECT *, (("end" - start) / length(original))::DOUBLE AS tightness FROM spans),
found AS (
  SELECT *, row_number() OVER (ORDER BY source_rank, tightness DESC, row_id)::INT AS rank
  FROM (SELECT * FROM tight ORDER BY source_rank, tightness DESC, row_id LIMIT {results}))
"""


def search_sql(core: str, coarse: str, **more) -> str:
    own = "poem_id" if more.get("titles") else "poem_id, row_id AS line_id"
    shown = 'start, "end", title, coalesce(poet, \'\') AS poet, line_count, source_id, source_rank, tightness, rank'
    return found(core, coarse, **more) + f"SELECT {own}, {shown} FROM found"


def has(text: str) -> str:
    return f"contains(plain, '{text}')"


def _quotes(x: str) -> str:
    return f"(length({x}) - length(replace({x}, '\"', '')))"


def cleaned_names(raw: str) -> str:
    """CTEs that end in ``cleaned`` (id, raw, name), for rows (id, raw) of ``raw``: one rule a step, nine steps a round."""
    from .operators.poet_names import FIRST_QUOTE, KNOWN_NOTES, LAST_QUOTE, LEAD, NOTED, TRAIL, UNKNOWN, YEAR

    text = lambda x: "'" + x.replace("'", "''") + "'"
    cut = lambda x, pattern: f"regexp_replace({x}, {text(pattern)}, '')"
    inside = trimmed("substr(name, 2, length(name) - 2)")
    depth = "len(replace(substr(name, 1, i), ')', '')) - len(replace(substr(name, 1, i), '(', ''))"
    known = ", ".join(map(text, KNOWN_NOTES))

    def before_note(noted: str) -> str:
        tag = trimmed(f"regexp_extract(name, {text(noted)}, 2)")
        note = f"regexp_matches(name, {text(noted)}) AND ({strip_all(tag)} IN ({known}) OR regexp_matches({tag}, {text(YEAR)}))"
        return f"CASE WHEN {note} THEN {cut(f'regexp_extract(name, {text(noted)}, 1)', TRAIL)} ELSE name END"

    rules = [
        cut("name", LEAD),
        f"CASE WHEN {_quotes('name')} % 2 = 1 THEN {cut('name', FIRST_QUOTE)} ELSE name END",
        cut("name", TRAIL),
        f"CASE WHEN {_quotes('name')} % 2 = 1 THEN {cut('name', LAST_QUOTE)} ELSE name END",
        f"CASE WHEN name LIKE '(%)' AND list_min(list_transform(range(1, length(name)), lambda i: {depth})) > 0 AND {depth.replace('1, i)', '1, length(name))')} = 0 THEN {inside} ELSE name END",
        f"CASE WHEN name LIKE '\"%\"' AND {_quotes('name')} = 2 THEN {inside} ELSE name END",
        *map(before_note, NOTED),
        trimmed("name"),
    ]
    cases = " ".join(f"WHEN {i} THEN {rule}" for i, rule in enumerate(rules))
    n = len(rules)
    return f"""names(id, raw) AS ({raw}),
steps(id, raw, name, before, step) AS (
  SELECT id, raw, raw, NULL::VARCHAR, 0 FROM names WHERE regexp_matches(raw, '[A-Za-z{LETTERS}]')
  UNION ALL
  SELECT id, raw, CASE step % {n} {cases} END, CASE WHEN step % {n} = 0 THEN name ELSE before END, step + 1
  FROM steps WHERE step % {n} <> 0 OR before IS NULL OR name <> before),
cleaned AS (
  SELECT id, raw, CASE WHEN length(name) > 1 THEN name ELSE raw END AS name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step DESC) AS nth FROM steps) WHERE nth = 1
  UNION ALL SELECT id, raw, '{UNKNOWN}' FROM names WHERE NOT regexp_matches(raw, '[A-Za-z{LETTERS}]')
  UNION ALL SELECT id, raw, NULL FROM names WHERE raw IS NULL)
"""
