"""SQL for the oracle engine, written from the rules and not from the Spark code."""

from __future__ import annotations

from trovelight import fixed_values as fixed

from .fixtures import ctes

ORACLES: dict[str, str] = {}
NL = "chr(10)"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_text(v) for v in values)


def _any_in(text: str, needles) -> str:
    return "(" + " OR ".join(f"contains({text}, {_text(n)})" for n in needles) + ")"


# --- search and packing --------------------------------------------------------------

_SAME_LANGUAGE = "(q.language IS NULL OR q.language = '' OR q.language = v.language)"
_COSINE = "list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[]))"
_L2 = "pow(list_distance(CAST(q.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[])), 2)"


def _hits(queries: str = "queries_fx", points: str = "vec_fx", on: str = _SAME_LANGUAGE) -> str:
    """CTEs up to ``hits``: cosine of at least 0.2, five per query."""
    return f"""
scored AS (SELECT q.query_id, v.*, {_COSINE} AS score FROM {queries} q JOIN {points} v ON {on}),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM scored WHERE score >= 0.2) WHERE rank <= 5)"""


_SCORES = "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits"
_BASE = ctes("vec_fx", "queries_fx")
_L2_HITS = f"""{_BASE}, hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank
  FROM (SELECT q.query_id, v.chunk_id, {_L2} AS score FROM queries_fx q JOIN vec_fx v ON {_SAME_LANGUAGE})) WHERE rank <= 5) {_SCORES}"""

_LINES = f"string_split(code, {NL})"
_SNIPPET = f"""concat('### [', upper(language), '] ', coalesce(repo, 'unknown'), '/', path, {NL}, 'Function: ', function_name, {NL}, '```', language, {NL},
  CASE WHEN len({_LINES}) > {fixed.SNIPPET_MAX_LINES} THEN concat(array_to_string({_LINES}[1:{fixed.SNIPPET_MAX_LINES}], {NL}), {_text(fixed.SNIPPET_TAIL)})
  ELSE coalesce(code, '') END, {NL}, '```')"""

ORACLES["context_pack"] = f"""{_BASE}, {_hits()},
snippets AS (SELECT query_id, rank, chunk_id, {_SNIPPET} AS snippet FROM hits),
totals AS (SELECT *, sum(length(snippet)) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM snippets),
packed AS (SELECT query_id, coalesce(string_agg(snippet, '' ORDER BY rank) FILTER (WHERE so_far <= {fixed.CONTEXT_MAX_CHARS}), '') AS context,
  count(*) FILTER (WHERE so_far <= {fixed.CONTEXT_MAX_CHARS}) AS packed, string_agg(chunk_id, '|' ORDER BY rank) AS chunk_ids FROM totals GROUP BY query_id)
SELECT query_id, concat({_text(fixed.PROMPT_BEFORE_CONTEXT)}, context, {_text(fixed.PROMPT_BEFORE_TASK)},
  replace(replace(query, '{{', ''), '}}', ''), {_text(fixed.PROMPT_AFTER_TASK)}) AS prompt, packed, chunk_ids
FROM packed JOIN queries_fx USING (query_id)"""

for _key in ("vector_topk", "vector_topk_blocks", "vector_table_search"):
    ORACLES[_key] = f"{_BASE}, {_hits()} {_SCORES}"
ORACLES["bounded_topk"] = f"{ctes('vec_fx', 'vec_queries_fx')}, {_hits(queries='vec_queries_fx')} {_SCORES}"
ORACLES["vector_topk_unfiltered"] = f"{_BASE}, {_hits(on='true')} {_SCORES}"
ORACLES["vector_topk_l2"] = ORACLES["flat_l2_index"] = _L2_HITS

ORACLES["vector_scores"] = f"""{ctes("pairs_fx")}, d AS (SELECT vec_id, CAST(vector AS DOUBLE[]) AS a, CAST(lead_vector AS DOUBLE[]) AS b FROM pairs_fx)
SELECT vec_id, round(sqrt(list_dot_product(a, a)), 6) AS norm, round(list_dot_product(a, b), 6) AS dot,
  round(list_cosine_similarity(a, b), 6) AS cosine, round(pow(list_distance(a, b), 2), 6) AS squared_l2 FROM d"""

ORACLES["hit_preview"] = f"""{_BASE}, {_hits()}
SELECT query_id, rank, CAST(rank AS VARCHAR) || '. ' || repo || ' / ' || path AS title,
  concat(substr(coalesce(code, ''), 1, {fixed.PREVIEW_CHARS}), '...') AS preview, language FROM hits WHERE rank <= {fixed.PREVIEW_HITS}"""

ORACLES["hit_ids"] = f"""{_BASE}, {_hits()}
SELECT query_id, string_agg(chunk_id, '|' ORDER BY rank) AS chunk_ids FROM hits GROUP BY query_id"""

_TOKENS = "regexp_split_to_array(lower({}), '[^a-z0-9]+')"
ORACLES["hits_in_repo"] = f"""{_BASE}, in_repo AS (SELECT * FROM vec_fx WHERE list_contains({_TOKENS.format('path')}, 'src7')),
{_hits(points="in_repo")} {_SCORES}"""
def _all_tokens(field: str, asked: str) -> str:
    import re

    wanted = sorted({t for t in re.split("[^a-z0-9]+", asked.lower()) if t})
    return f"list_has_all({_TOKENS.format(field)}, [{_list(wanted)}]::VARCHAR[])" if wanted else "true"


def _indexed(questions) -> str:
    parts = [f"SELECT {_text(f)} AS field, {_text(a)} AS asked, chunk_id FROM vec_fx WHERE {f} IS NOT NULL AND {_all_tokens(f, a)}"
             for f, a in questions]
    return f"{ctes('vec_fx')} " + " UNION ALL ".join(parts)


ORACLES["token_search"] = f"""{ctes("vec_fx")} SELECT chunk_id, list_contains({_TOKENS.format('path')}, 'src7') AS in_src7,
  list_contains({_TOKENS.format('repo')}, 'src') AS partial_token FROM vec_fx"""

# --- chunking --------------------------------------------------------------------------

_EXTENSIONS = "ext_dim(ext, language) AS (VALUES " + ", ".join(
    f"({_text(e)}, {_text(l)})" for e, l in fixed.EXTENSION_LANGUAGE.items()) + ")"
_SUFFIX = r"regexp_extract({}, '^.+(\.[^.]+)$', 1, 's')"
_FILE_NAME = "concat(owner, '__', repo_name, '__', replace(path, '/', '__'))"

_NAMED = f"""{ctes("files_fx")}, {_EXTENSIONS},
named AS (SELECT {_FILE_NAME} AS file_name, code FROM files_fx),
files AS (SELECT n.*, e.language, split_part(file_name, '__', 1) AS repo FROM named n JOIN ext_dim e ON e.ext = {_SUFFIX.format('file_name')})"""

_PATTERN = "CASE language " + " ".join(
    f"WHEN {_text(l)} THEN {_text(p)}" for l, p in fixed.FUNCTION_PATTERNS.items()) + " END"
_BY_LANGUAGE = " ".join(
    f"WHEN {_text(l)} THEN regexp_extract_all(code, {_text(p.replace('{', chr(92) + '{').replace('}', chr(92) + '}'))}, 1)"
    for l, p in fixed.FUNCTION_PATTERNS.items())

_REGEX = f"""regex_rows AS (SELECT language, repo, file_name AS path, unnest(range(len(found))) AS ordinal, unnest(found) AS code
  FROM (SELECT *, CASE language {_BY_LANGUAGE} END AS found FROM files WHERE language IN ({_list(fixed.FUNCTION_PATTERNS)}))),
regex_chunks AS (SELECT language, repo, path, ordinal, concat('func_', ordinal) AS function_name, code FROM regex_rows)"""

_WHOLE = f"""whole_chunks AS (SELECT language, repo, file_name AS path, CAST(0 AS BIGINT) AS ordinal, 'default' AS function_name, code FROM files
  WHERE language NOT IN ({_list([*fixed.FUNCTION_PATTERNS, 'python', 'javascript'])}) AND length(code) < {fixed.WHOLE_FILE_MAX_CHARS})"""

# The fixture's Python and JavaScript files have one known shape; anything else in them is prose.
_PYTHON = r"""python_files AS (SELECT *, regexp_extract(code, '^import os\ndef (f\d+)\(x\):\n', 1) AS f FROM files WHERE language = 'python'),
python_chunks AS (
  SELECT language, repo, file_name AS path, CAST(0 AS BIGINT) AS ordinal, f AS function_name,
    concat('def ', f, '(x):', chr(10), '    def g(y): return y', chr(10), '    return g(x)') AS code FROM python_files WHERE f <> ''
  UNION ALL SELECT language, repo, file_name, 1, 'g', 'def g(y): return y' FROM python_files WHERE f <> ''
  UNION ALL SELECT language, repo, file_name, 2, 'h', 'async def h(self): return 1' FROM python_files WHERE f <> '')"""
_JAVASCRIPT = r"""js_files AS (SELECT *, regexp_extract(code, '^function f(\d+)\(a\)', 1) AS n FROM files WHERE language = 'javascript'),
js_chunks AS (
  SELECT language, repo, file_name AS path, CAST(0 AS BIGINT) AS ordinal, concat('f', n) AS function_name,
    concat('function f', n, '(a) { return a; }') AS code FROM js_files WHERE n <> ''
  UNION ALL SELECT language, repo, file_name, 1, concat('g', n),
    concat('function g', n, '(b)', chr(10), '{', chr(10), '  if (b) { run(); }', chr(10), '}') FROM js_files WHERE n <> '')"""


def _with_id(source: str) -> str:
    return f"""SELECT concat(language, '__', repo, '__', function_name, '__',
  substr(md5(concat(language, '_', repo, '_', path, '_', function_name, '_', substr(code, 1, {fixed.ID_CODE_CHARS}))), 1, {fixed.ID_HASH_CHARS})) AS chunk_id,
  language, repo, path, function_name, code, ordinal FROM {source}"""


ORACLES["chunks_regex"] = f"{_NAMED}, {_REGEX} {_with_id('regex_chunks')}"
ORACLES["chunks_default"] = f"{_NAMED}, {_WHOLE} {_with_id('whole_chunks')}"
ORACLES["chunks_python"] = f"{_NAMED}, {_PYTHON} {_with_id('python_chunks')}"
ORACLES["chunks_javascript"] = f"{_NAMED}, {_JAVASCRIPT} {_with_id('js_chunks')}"
_ALL = f"""{_NAMED}, {_REGEX}, {_WHOLE}, {_PYTHON}, {_JAVASCRIPT},
all_chunks AS (SELECT * FROM regex_chunks UNION ALL BY NAME SELECT * FROM whole_chunks
  UNION ALL BY NAME SELECT * FROM python_chunks UNION ALL BY NAME SELECT * FROM js_chunks),
chunks AS ({_with_id('all_chunks')})"""
ORACLES["chunks_all"] = f"{_ALL} SELECT * FROM chunks"
# Files read back as text have line feeds only.
ORACLES["raw_scan"] = ORACLES["chunks_all"].replace(
    "AS file_name, code FROM files_fx",
    f"AS file_name, replace(replace(code, concat(chr(13), {NL}), {NL}), chr(13), {NL}) AS code FROM files_fx", 1)
_LATEST = "(SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY path DESC, ordinal DESC) AS rn FROM chunks) WHERE rn = 1"
for _key in ("chunk_ids", "stream_upsert", "stream_after_batch"):
    ORACLES[_key] = f"{_ALL} SELECT chunk_id, path FROM {_LATEST}"
ORACLES["point_count"] = f"{_ALL} SELECT count(DISTINCT chunk_id) AS points, true AS differs_is_error FROM chunks"
ORACLES["corpus_build"] = f"{_ALL} SELECT chunk_id, language, repo, path, function_name FROM {_LATEST}"
ORACLES["dataset_export"] = f"""{_ALL} SELECT language, count(*) AS chunks, (SELECT count(*) FROM chunks) AS samples FROM chunks GROUP BY language"""
ORACLES["sink_roundtrip"] = f"{_ALL} SELECT * EXCLUDE (ordinal) FROM chunks"

_LOADS = f"""{_ALL}, first_load AS (SELECT * FROM chunks), whole AS (SELECT * FROM chunks WHERE function_name = 'default'),
second_load AS (SELECT * FROM whole UNION ALL BY NAME
  SELECT * REPLACE (concat(code, {NL}, '// revised') AS code) FROM first_load WHERE language IN ('go', 'ruby', 'python')),
loads AS (SELECT *, 0 AS seq FROM first_load UNION ALL BY NAME SELECT *, 1 AS seq FROM second_load),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC, path DESC, ordinal DESC) AS rn FROM loads) WHERE rn = 1)"""
for _key in ("chunk_upsert", "last_write_wins", "vector_table"):
    ORACLES[_key] = f"{_LOADS} SELECT chunk_id, language, path, code FROM kept"
ORACLES["load_counts"] = f"""{_LOADS} SELECT 'offered' AS metric, count(*) AS rows FROM second_load
UNION ALL SELECT 'loaded', count(DISTINCT chunk_id) FROM second_load UNION ALL SELECT 'points', count(*) FROM kept"""

# --- inventory -------------------------------------------------------------------------

_NAME = "string_split(path, '/')[-1]"
_LOWER_PATH = r"lower(replace(path, '\', '/'))"
_INVENTORY = f"""{ctes("files_fx")}, {_EXTENSIONS},
sized AS (SELECT *, CAST(strlen(code) AS BIGINT) AS size_bytes, lower({_SUFFIX.format(_NAME)}) AS extension,
  replace(replace(code, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)) AS unix FROM files_fx),
inventory AS (SELECT s.owner, s.repo_name, s.path, e.language, s.extension, s.size_bytes,
  CAST(length(unix) - length(replace(unix, {NL}, '')) + CASE WHEN unix = '' OR suffix(unix, {NL}) THEN 0 ELSE 1 END AS BIGINT) AS all_lines,
  {_any_in(_LOWER_PATH, fixed.TEST_MARKERS)} AS is_test_file, {_NAME} IN ({_list(fixed.ENTRY_POINT_NAMES)}) AS is_entry_point,
  e.language IS NOT NULL AS is_supported,
  NOT (len(list_intersect(string_split(path, '/'), [{_list(fixed.IGNORED_NAMES)}])) > 0 OR s.extension IN ({_list(fixed.IGNORED_EXTENSIONS)}))
    AND size_bytes > 0 AND size_bytes <= 100000 AS is_indexed
  FROM sized s LEFT JOIN ext_dim e ON e.ext = s.extension),
files_out AS (SELECT * EXCLUDE (all_lines), CASE WHEN is_indexed THEN all_lines END AS line_count FROM inventory)"""

ORACLES["file_inventory"] = f"{_INVENTORY} SELECT * FROM files_out"
ORACLES["source_scan"] = f"{_INVENTORY} SELECT * EXCLUDE (owner, repo_name) FROM files_out"
ORACLES["repo_totals"] = f"""{_INVENTORY} SELECT owner, repo_name, count(*) AS total_files,
  count(*) FILTER (WHERE is_indexed) AS indexed_files FROM files_out GROUP BY owner, repo_name"""
ORACLES["repo_languages"] = f"""{_INVENTORY} SELECT owner, repo_name, language, count(*) AS files
FROM files_out WHERE is_indexed AND language IS NOT NULL GROUP BY owner, repo_name, language"""
ORACLES["repo_documents"] = f"""{_INVENTORY} SELECT owner, repo_name, count(*) AS total_files,
  count(*) FILTER (WHERE is_indexed) AS indexed_files, count(DISTINCT language) FILTER (WHERE is_indexed) AS languages,
  coalesce(string_agg(concat_ws(':', path, language, line_count), '|' ORDER BY concat_ws(':', path, language, line_count)) FILTER (WHERE is_indexed), '') AS files
FROM files_out GROUP BY owner, repo_name"""

ORACLES["repo_records"] = f"""{_INVENTORY},
totals AS (SELECT owner, repo_name, count(*) AS total_files, count(*) FILTER (WHERE is_indexed) AS indexed_files FROM files_out GROUP BY owner, repo_name)
SELECT concat(t.owner, '/', t.repo_name) AS url, t.total_files, t.indexed_files, f.path, f.line_count
FROM totals t LEFT JOIN (SELECT * FROM files_out WHERE is_indexed) f USING (owner, repo_name)"""

ORACLES["parse_repo_url"] = f"""{ctes("urls_fx")},
bare AS (SELECT page_id, url, regexp_replace(rtrim(url, '/'), '\\.git$', '') AS u FROM urls_fx),
parts AS (SELECT *, string_split(CASE WHEN contains(u, '://') THEN substr(u, strpos(u, '://') + 3) ELSE u END, '/') AS p FROM bare)
SELECT page_id, url, CASE WHEN ok THEN p[2] END AS owner, CASE WHEN ok THEN p[3] END AS name, ok AS is_valid
FROM (SELECT *, len(p) >= 3 AND p[1] = 'github.com' AS ok FROM parts)"""

# --- selection -------------------------------------------------------------------------


def _top_repos(source: str, top: int) -> str:
    return f"""best AS (SELECT language, full_name, max(stars) AS stars FROM {source} WHERE license = 'mit' AND stars >= 500 GROUP BY language, full_name),
chosen AS (SELECT * FROM (SELECT language, full_name, split_part(full_name, '/', 1) AS owner, split_part(full_name, '/', 2) AS repo_name, stars,
  row_number() OVER (PARTITION BY language ORDER BY stars DESC, full_name) AS rank FROM best) WHERE rank <= {top})"""


ORACLES["select_repos"] = f"{ctes('repos_fx')}, {_top_repos('repos_fx', 30)} SELECT * FROM chosen"

_SIZED = "CAST(strlen(code) AS BIGINT) AS size_bytes"
ORACLES["select_files"] = f"""{ctes("files_fx")}, {_EXTENSIONS},
matched AS (SELECT e.language, owner, repo_name, ordinal, path, {_SIZED},
  row_number() OVER (PARTITION BY e.language, owner, repo_name ORDER BY ordinal, path) AS position
  FROM files_fx JOIN ext_dim e ON ends_with(path, e.ext))
SELECT *, {_FILE_NAME} AS file_name FROM matched WHERE position <= 2 AND size_bytes < 20000"""
ORACLES["corpus_files"] = f"""{ctes("files_fx", "file_repos_fx")}, {_EXTENSIONS}, {_top_repos('file_repos_fx', 8)},
matched AS (SELECT c.language, owner, repo_name, path, code, {_SIZED},
  row_number() OVER (PARTITION BY c.language, owner, repo_name ORDER BY ordinal, path) AS position
  FROM files_fx f JOIN chosen c USING (owner, repo_name) JOIN ext_dim e ON e.language = c.language AND ends_with(path, e.ext))
SELECT language, {_FILE_NAME} AS file_name, code FROM matched WHERE position <= 3 AND size_bytes < 20000"""
_SUMMARY = f"""{ctes("files_fx")}, {_EXTENSIONS},
scraped AS (SELECT e.language, {_FILE_NAME} AS file_name FROM files_fx JOIN ext_dim e ON ends_with(path, e.ext)),
summary AS (SELECT language, count(DISTINCT split_part(file_name, '__', 2)) AS repos, count(*) AS files FROM scraped GROUP BY language)"""
ORACLES["scrape_summary"] = f"{_SUMMARY} SELECT * FROM summary"
ORACLES["languages_pending"] = f"""{_SUMMARY} SELECT language FROM ext_dim
WHERE language NOT IN (SELECT language FROM summary WHERE repos >= 2)"""

# --- prompts ---------------------------------------------------------------------------

_SPACE = _text(fixed.PYTHON_WHITESPACE)
_VERDICT = f"""CASE WHEN trim(query, {_SPACE}) = '' THEN 'empty' WHEN length(trim(query, {_SPACE})) < {fixed.PROMPT_MIN_CHARS} THEN 'too_short'
  WHEN length(query) > {fixed.PROMPT_MAX_CHARS} THEN 'too_long' WHEN {_any_in('lower(query)', fixed.BLOCKED_PHRASES)} THEN 'restricted' ELSE 'ok' END"""
_MESSAGE = "CASE reason " + " ".join(
    f"WHEN {_text(k)} THEN {_text(m)}" for k, m in fixed.PROMPT_MESSAGES.items()) + " END"
_LANGUAGE = "CASE " + " ".join(
    f"WHEN {_any_in('lower(query)', words)} THEN {_text(lang)}" for lang, words in fixed.LANGUAGE_KEYWORDS.items()) + " END"

ORACLES["validate_prompts"] = f"""{ctes("prompts_fx")}
SELECT query_id, reason = 'ok' AS is_valid, reason, {_MESSAGE} AS message FROM (SELECT *, {_VERDICT} AS reason FROM prompts_fx)"""
ORACLES["infer_language"] = f"""{ctes("prompts_fx")} SELECT query_id, {_LANGUAGE} AS language FROM prompts_fx WHERE {_VERDICT} = 'ok'"""
ORACLES["sql_infer_language"] = f"""{ctes("prompts_fx")} SELECT query_id, {_LANGUAGE} AS language FROM prompts_fx"""

_BREAKS = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
_CLEAN = f"""cleaned AS (SELECT query_id, CASE WHEN NOT starts_with(t, '```') THEN t
  WHEN len(l) >= 3 THEN trim(array_to_string(l[2:-2], {NL}), {_SPACE}) ELSE trim(array_to_string(l, {NL}), {_SPACE}) END AS response
  FROM (SELECT query_id, t, regexp_split_to_array(t, {_BREAKS}) AS l FROM (SELECT query_id, trim(coalesce(response, ''), {_SPACE}) AS t FROM responses_fx))),
kinds AS (SELECT query_id, response, CASE WHEN {_any_in('response', fixed.CODE_RESPONSE_MARKERS)} THEN 'code' ELSE 'markdown' END AS kind FROM cleaned)"""
ORACLES["clean_responses"] = f"{ctes('responses_fx')}, {_CLEAN} SELECT * FROM kinds"

_RECORDS = f"""{ctes("vec_fx", "prompt_vectors_fx", "responses_fx")}, {_CLEAN},
asked AS (SELECT *, {_LANGUAGE} AS language FROM prompt_vectors_fx WHERE {_VERDICT} = 'ok'), {_hits(queries="asked")},
lists AS (SELECT query_id, string_agg(chunk_id, '|' ORDER BY rank) AS chunk_ids FROM hits GROUP BY query_id)"""
ORACLES["interaction_log"] = f"""{_RECORDS} SELECT query_id, query, language, response, kind, coalesce(language, 'text') AS display_language, chunk_ids
FROM asked JOIN kinds USING (query_id) JOIN lists USING (query_id)"""
ORACLES["log_append"] = f"""{_RECORDS} SELECT query, language, response, chunk_ids
FROM asked JOIN kinds USING (query_id) JOIN lists USING (query_id)"""

# --- embedding -------------------------------------------------------------------------


def _encoded(rows: str, key: str, text: str) -> str:
    """CTEs up to ``encoded``: each row's words hashed into 64 places, at unit length."""
    return f"""numbered AS (SELECT *, row_number() OVER () AS rid FROM {rows}),
words AS (SELECT rid, {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM numbered),
places AS (SELECT rid, {key}, CAST(concat('0x', substr(md5(word), 1, 8)) AS BIGINT) % 64 AS place, count(*) AS n FROM words GROUP BY ALL),
encoded AS (SELECT {key}, place, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY rid)) AS FLOAT) AS DOUBLE), 6) AS value FROM places)"""


ORACLES["embed_corpus"] = f"{_ALL}, {_encoded('chunks', 'chunk_id', 'code')} SELECT * FROM encoded"
ORACLES["embed_prompts"] = f"{ctes('prompts_fx')}, {_encoded('prompts_fx', 'query_id', 'query')} SELECT * FROM encoded"
ORACLES["encoder_fallback"] = f"""{ctes('prompts_fx')}, {_encoded('prompts_fx', 'query_id', 'query')}
SELECT 'md5-hashing-64' AS encoder, query_id, place, value FROM encoded"""
ORACLES["vector_payload_join"] = f"""{ctes("vec_fx", "vectors_fx")} SELECT p.chunk_id, p.language,
  round(sqrt(list_dot_product(CAST(v.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[]))), 6) AS norm
FROM vec_fx p JOIN vectors_fx v USING (chunk_id)"""

from .queries import INDEX_QUESTIONS  # noqa: E402

ORACLES["indexed_tokens"] = _indexed(INDEX_QUESTIONS)

ORACLES["sql_parse_repo_url"] = ORACLES["parse_repo_url"]
ORACLES["sql_chunk_id"] = f"""{ctes("vec_fx")} SELECT chunk_id AS point, concat_ws({_text(fixed.ID_SEPARATOR)}, language, repo, function_name,
  substr(md5(concat_ws({_text(fixed.ID_HASH_SEPARATOR)}, language, repo, path, function_name, substr(code, 1, {fixed.ID_CODE_CHARS}))), 1, {fixed.ID_HASH_CHARS})) AS id
FROM vec_fx"""
