"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, needed, template_words
from .preferences import END
from .quality_rules import STOP_WORDS


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t,
    list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls
  FROM d),
u AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM w),
v AS (
  SELECT rid, p, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c
  FROM u WINDOW o AS (PARTITION BY rid ORDER BY p)),
g AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM v WHERE c IS NOT NULL),
h AS (SELECT DISTINCT rid, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1),
r AS (SELECT rid, count(*) AS n FROM h GROUP BY rid),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: list_contains({_list(STOP_WORDS)}, lower(x)))) AS stops,
    coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS longest
  FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 1.5 AND 25
  AND n_symbols / greatest(n_words, 1) <= 0.5 AND stops / greatest(n_words, 1) >= 0.02
  AND n_dup_lines / greatest(n_lines, 1) <= 0.6 AND longest <= 20000 AS kept
FROM f
"""


def _turn(t: str) -> str:
    return f"'<|' || coalesce({t}.role, '') || '|>' || chr(10) || coalesce({t}.text, '') || '{END.strip()}' || chr(10)"


def _rendered(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda t: {_turn('t')}), '')"


def _mask(turns: str) -> str:
    """Spans out of the running length of the rendered turns."""
    before = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda t: length({_turn('t')}))), 0)::BIGINT"
    turn = f"{turns}[i]"
    start = f"({before} + length('<|' || coalesce({turn}.role, '') || '|>' || chr(10)))"
    end = f"({before} + length({_turn(turn)}))"
    places = f"list_filter(range(1, len({turns}) + 1), lambda i: {turn}.role = 'assistant')"
    return f"array_to_string(list_transform({places}, lambda i: {start}::BIGINT || ':' || {end}::BIGINT), ',')"


OP7 = f"""
WITH c AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns
  FROM conversations GROUP BY conv_id),
m AS (SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS place FROM c),
a AS (SELECT conv_id - 1 AS conv_id, turns[place] AS answer FROM m WHERE place IS NOT NULL),
p AS (
  SELECT m.conv_id, turns AS chosen,
    list_concat(turns[1:coalesce(place - 1, len(turns))], CASE WHEN answer IS NULL THEN [] ELSE [answer] END) AS rejected
  FROM m LEFT JOIN a USING (conv_id)),
q AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(chosen), len(rejected)) + 1),
    lambda i: i > len(chosen) OR i > len(rejected) OR chosen[i] IS DISTINCT FROM rejected[i])) - 1, len(chosen))::INT AS n FROM p),
s AS (SELECT conv_id, n, chosen[1:n] AS head, chosen[n + 1:] AS good, rejected[n + 1:] AS bad FROM q)
SELECT conv_id, n AS n_prompt_turns, {_rendered('head')} AS prompt,
  {_rendered('good')} AS chosen_completion, {_mask('good')} AS chosen_mask,
  {_rendered('bad')} AS rejected_completion, {_mask('bad')} AS rejected_mask
FROM s
"""


def _place(phrase: str) -> str:
    return " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))


_TEMPLATES = ", ".join(f"('{label}', {_list(template_words(text))}, {needed(len(template_words(text)))})" for label, text in TEMPLATES)

OP8 = f"""
WITH t(label, words, need) AS (VALUES {_TEMPLATES}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents),
w AS (SELECT rid, doc_id, low, list_filter(regexp_split_to_array(low, '[\\x00-/:-`{{-\\x7f]+'), lambda x: x <> '') AS w FROM d),
b AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n_words, list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'place': i - 1,
    'label': CASE {' '.join(f"WHEN {_place(phrase)} THEN '{label}'" for phrase, label in PHRASES)} END}}),
    lambda x: x.label IS NOT NULL) AS found
  FROM w),
l AS (SELECT rid, unnest(string_split(low, chr(10))) AS line FROM w),
k AS (SELECT rid, list_distinct(regexp_split_to_array(line, '[\\x00-/:-`{{-\\x7f]+')) AS words FROM l),
j AS (
  SELECT rid, label, len(list_intersect(k.words, t.words)) / len(t.words) AS score
  FROM k, t WHERE len(list_intersect(k.words, t.words)) >= need),
m AS (SELECT rid, list(label) AS labels, max(score) AS score FROM j GROUP BY rid)
SELECT doc_id, n_words, len(found)::BIGINT AS n_base,
  list_min(list_transform(found, lambda x: x.place))::BIGINT AS first_word,
  list_max(list_transform(found, lambda x: x.place))::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(found, lambda x: x.label), coalesce(m.labels, [])))), ',') AS labels,
  coalesce(m.score, 0)::DOUBLE AS score
FROM b LEFT JOIN m USING (rid)
"""

#: Every phrase of up to five words is a row; the empty one holds a language's words.
OP13 = """
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(low, '[.,;:!?\\n-\\r]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM p),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM s, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
x AS (
  SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, n.n, (1000 * a::HUGEINT * n.n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k], ' ')
    JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1:], ' ') JOIN n ON n.lang = k.lang),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, a, unnest(list_filter(flatten(list_transform(range(1, m), lambda o: list_transform(range(2, m), lambda z:
    CASE WHEN o + z - 1 <= m THEN array_to_string(ws[o:o + z - 1], ' ') END))), lambda q: q IS NOT NULL)) AS phrase
  FROM c WHERE m > 2),
j AS (SELECT lang, phrase, max(a) AS around FROM i GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM y LEFT JOIN j USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a
QUALIFY rank <= 2000
"""

ORACLE_SQL = {"op4_quality_rules": OP4, "op7_chat_formatting": OP7, "op8_license_scans": OP8, "op13_phrase_collocations": OP13}
