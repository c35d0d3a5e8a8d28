"""Pieces of SQL that the oracle statements share (DuckDB's dialect)."""

from __future__ import annotations

from quarrylight.functions import text as T
from quarrylight.operators import fusion, lexical


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def terms(x: str) -> str:
    return f"regexp_extract_all(translate({fold(f'coalesce({x}, {quoted(str())})')}, '−–', '--'), {quoted(T.TERM)})"


def keywords(x: str) -> str:
    stop = ", ".join(quoted(w) for w in T.STOPWORDS)
    return (
        f"array_to_string(list_filter(regexp_extract_all({x}, {quoted(T.WORD)}), "
        f"lambda w: NOT list_contains([{stop}], {fold('w')}) AND length(w) > 1), ' ')"
    )


def variants(x: str) -> str:
    forms = [x, f"CASE WHEN {keywords(x)} <> '' AND {fold(keywords(x))} <> {fold(x)} THEN {keywords(x)} END"]
    for triggers, words in T.EXPANSIONS:
        hit = " OR ".join(f"contains({fold(x)}, {quoted(t)})" for t in triggers)
        forms += [f"CASE WHEN {hit} THEN {x} || ' ' || {quoted(words)} END", f"CASE WHEN {hit} THEN {quoted(words)} END"]
    return "[" + ", ".join(forms) + "]"


def first_case(pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {quoted(v)}" for c, v in pairs) + " END"


def line(x: str) -> str:
    t = f"replace(replace({x}, chr(160), ' '), chr(173), '')"
    t = f"regexp_replace({t}, '^\\s{{0,3}}#{{1,6}}\\s+', '')"
    t = f"regexp_replace({t}, '^\\s*\\|*\\s*|\\s*\\|*\\s*$', '', 'g')"
    t = f"regexp_replace({t}, '[*_]{{1,3}}', '', 'g')"
    t = f"regexp_replace({t}, '(?i)\\b(factor|statement|financial|consolidated|management)\\s+s\\b', '\\1s', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def heading(x: str, page: str) -> str:
    t = line(x)
    found = first_case([(f"regexp_matches({t}, {quoted('(?i)' + p)})", s) for p, s in T.HEADINGS])
    skip = (
        f"length({t}) > 180 OR coalesce({page} <= 18, false) AND regexp_matches({t}, '(\\.{{2,}}|\\s)[0-9]{{1,4}}\\s*$') "
        f"OR regexp_matches({t}, '(?i)\\bfor\\s+obligor\\s+group\\b')"
    )
    return f"CASE WHEN {t} <> '' AND NOT ({skip}) THEN {found} END"


def body_section(x: str) -> str:
    return first_case([(f"regexp_matches(substring({x}, 1, 1500), {quoted('(?i)' + p)})", s) for p, s in T.BODY_CUES])


def preferred(x: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({fold(x)}, {quoted(cue)}) THEN {quoted(name)} END" for name, cue in T.SECTION_CUES)
    return f"list_filter([{cases}], lambda s: s IS NOT NULL)"


def years(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({fold(x)}, '\\b(?:fy\\s*)?(20[0-9]{{2}})\\b', 1), lambda y: CAST(y AS INTEGER))))"


def doc_key(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"


CORPUS = """corpus AS (
    SELECT DISTINCT ON (chunk_id) *,
        CASE WHEN trim(coalesce(context_header, '')) <> '' THEN context_header || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS indexed
    FROM chunks WHERE chunk_id IS NOT NULL ORDER BY chunk_id)"""
QUESTIONS = "q AS (SELECT DISTINCT financebench_id AS query_id, question FROM questions WHERE financebench_id IS NOT NULL)"
INDEX = f"""docs AS (SELECT chunk_id, {terms("indexed")} AS terms FROM corpus),
post AS (SELECT chunk_id, len(terms) AS dl, unnest(terms) AS term FROM docs),
tfs AS (SELECT chunk_id, dl, term, count(*) AS tf FROM post GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM docs),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tfs, stats GROUP BY term),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN {lexical.EPSILON} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def scores(name: str, queries: str) -> str:
    """CTE ``name`` of (query_id, chunk_id, score) for a relation of (query_id, query)."""
    k1, b = lexical.K1, lexical.B
    return f"""{name}_terms AS (SELECT query_id, unnest({terms("query")}) AS term FROM {queries}),
{name}_weights AS (SELECT query_id, term, count(*) * any_value(idf) AS weight FROM {name}_terms JOIN idfs USING (term) GROUP BY ALL),
{name} AS (SELECT query_id, chunk_id, sum(weight * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
    FROM tfs JOIN {name}_weights USING (term), stats GROUP BY ALL)"""


def top(k: int, source: str, group: str = "query_id") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {k}"""


FILTERS = f"""named AS (SELECT DISTINCT company, {fold("company")} AS name FROM chunks WHERE trim(company) <> ''),
tokens AS (SELECT company, name, list_distinct(regexp_extract_all(name, '[a-z0-9]+')) AS tokens,
    list_filter(list_distinct(regexp_extract_all(name, '[a-z0-9]+')), lambda t: NOT list_contains([{", ".join(quoted(w) for w in T.COMPANY_WORDS)}], t)) AS own FROM named),
met AS (SELECT query_id, company, contains({fold("question")}, name) AS whole,
    len(list_intersect(own, regexp_extract_all({fold("question")}, '[a-z0-9]+'))) AS overlap, len(own) AS n_own FROM q, tokens),
chosen AS (SELECT DISTINCT ON (query_id) query_id, company FROM met WHERE whole OR overlap > 0
    ORDER BY query_id, whole DESC, CASE WHEN whole THEN length(company) ELSE overlap END DESC, CASE WHEN whole THEN 0 ELSE n_own END DESC,
        CASE WHEN whole THEN company END, company DESC),
filters AS (SELECT query_id, company, CASE WHEN len({years("question")}) = 1 THEN {years("question")}[1] END AS fiscal_year
    FROM q LEFT JOIN chosen USING (query_id))"""
VECTORS = """vecs AS (
    SELECT DISTINCT ON (vec_id) vec_id, chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM chunk_vectors
    WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY vec_id),
units AS (SELECT vec_id, chunk_id, e, sqrt(list_dot_product(e, e)) AS norm FROM vecs)"""
COSINE = "list_dot_product(a.e, b.e) / (a.norm * b.norm)"

VARIANTS = f"""forms AS (SELECT query_id, question, list_filter({variants("question")}, lambda v: v IS NOT NULL) AS every FROM q),
variants AS (SELECT query_id, question, i AS list_no, kept[i] AS query FROM (
    SELECT query_id, question, list_filter(every, lambda v, i: NOT list_contains(list_transform(every[1:i-1], lambda y: {fold("y")}), {fold("v")}))[1:3] AS kept
    FROM forms), range(1, 4) t(i) WHERE i <= len(kept))"""
_tables = f"regexp_matches({fold('question')}, {quoted(T.TABLE_CUE)})"
VALUE = (
    f"round(score + CASE WHEN list_contains({preferred('question')}, section) THEN {fusion.SECTION_BONUS} ELSE 0.0 END "
    f"+ CASE WHEN {_tables} AND content_type = 'table' THEN {fusion.TABLE_BONUS} ELSE 0.0 END, 9)"
)
