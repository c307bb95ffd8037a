"""Input views shared by the Spark queries and the SQL oracles.

The given tables hold prose, so each view dresses whole tables up as source files,
repositories, prompts and so on. One SQL text serves both engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "embeddings", "conversations", "pages", "customer")

VIEWS: dict[str, str] = {}

VIEWS["files_fx"] = """
WITH d AS (SELECT doc_id, source, text, chr(10) AS nl, CAST(doc_id AS STRING) AS id,
  CASE doc_id % 13 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.java' WHEN 4 THEN '.go' WHEN 5 THEN '.rb'
    WHEN 6 THEN '.sh' WHEN 7 THEN '.sql' WHEN 8 THEN '.R' WHEN 9 THEN '.json' WHEN 10 THEN '.png' WHEN 11 THEN '.xyz' ELSE '' END AS ext,
  CASE doc_id % 7 WHEN 0 THEN 'main' WHEN 1 THEN 'app' WHEN 2 THEN 'test_auth' WHEN 3 THEN 'auth_test' WHEN 4 THEN 'utils' WHEN 5 THEN 'index' ELSE 'build' END AS name,
  CASE doc_id % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'node_modules/' WHEN 3 THEN 'src/api/' ELSE 'x/Tests/' END AS dir FROM documents),
c AS (SELECT d.*, CASE
  WHEN doc_id % 97 = 0 THEN ''
  WHEN doc_id % 101 = 0 THEN repeat(text, 80)
  WHEN ext = '.py' THEN concat('import os', nl, 'def f', id, '(x):', nl, '    def g(y): return y', nl, '    return g(x)', nl, 'class A:', nl, '    async def h(self): return 1', nl, '# ', replace(text, nl, concat(nl, '# ')))
  WHEN ext IN ('.js', '.ts') THEN concat('function f', id, '(a) { return a; }', nl, 'function g', id, '(b)', nl, '{', nl, '  if (b) { run(); }', nl, '}', nl, '// ', replace(text, nl, ' '))
  WHEN ext = '.java' THEN concat('class A {', nl, 'public static int f', id, '(int a) { return a; }', nl, '}', nl, '// ', replace(text, nl, ' '))
  WHEN ext = '.go' THEN concat('func f', id, '(a int) {', nl, '}', nl, '// ', replace(text, nl, ' '))
  WHEN ext = '.rb' THEN concat('def f', id, nl, '  1', nl, 'end', nl)
  WHEN ext = '.sh' THEN concat('function f', id, ' () {', nl, '  ls', nl, '}', nl)
  WHEN doc_id % 3 = 0 THEN replace(text, nl, concat(chr(13), nl))
  ELSE text END AS code FROM d)
SELECT doc_id AS ordinal, source AS owner, concat('repo', CAST(doc_id % 2 AS STRING)) AS repo_name,
  concat(dir, 'd', id, '/', name, ext) AS path, code FROM c
"""

VIEWS["repos_fx"] = """
SELECT concat('o', CAST(c_custkey % 300 % 25 AS STRING), '/r', CAST(c_custkey % 300 AS STRING)) AS full_name,
  CASE c_custkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'rust' WHEN 3 THEN 'java' WHEN 4 THEN 'c' ELSE 'sql' END AS language,
  CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 'mit' ELSE 'apache-2.0' END AS license,
  CAST(floor(c_acctbal) AS BIGINT) AS stars FROM customer
"""

# Repositories that the files of files_fx belong to, listed under two languages each.
VIEWS["file_repos_fx"] = """
WITH r AS (SELECT source, doc_id % 2 AS side, sum(n_chars) AS stars FROM documents GROUP BY source, doc_id % 2),
l AS (SELECT r.*, 'go' AS language FROM r UNION ALL SELECT r.*, CASE side WHEN 0 THEN 'python' ELSE 'ruby' END AS language FROM r)
SELECT concat(source, '/repo', CAST(side AS STRING)) AS full_name, language,
  CASE WHEN source = 'src3' THEN 'apache-2.0' ELSE 'mit' END AS license, CAST(stars AS BIGINT) AS stars FROM l
"""

_LABEL_LANGUAGE = "CASE label % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'rust' ELSE 'java' END"

# Every vector with every document: documents take the vectors in turn, vectors without one keep nulls.
_PLACED = "(SELECT doc_id, source, text, doc_id % (SELECT count(*) FROM embeddings) AS vec FROM documents)"
VIEWS["vec_fx"] = f"""
SELECT concat({_LABEL_LANGUAGE}, '__', coalesce(d.source, 'none'), '__f', CAST(coalesce(d.doc_id, e.vec_id) AS STRING)) AS chunk_id,
  {_LABEL_LANGUAGE} AS language, d.source AS repo,
  CASE WHEN d.source IS NOT NULL THEN concat(d.source, '__', CAST(d.doc_id AS STRING)) END AS path,
  CASE WHEN d.source IS NOT NULL THEN concat('f', CAST(d.doc_id AS STRING)) END AS function_name,
  d.text AS code, e.embedding AS vector FROM embeddings e LEFT JOIN {_PLACED} d ON d.vec = e.vec_id
"""

# Vectors of the same content that arrive as a table of their own: some ids are unknown there, some only there.
VIEWS["vectors_fx"] = f"""
SELECT CASE WHEN vec_id % 10 = 3 THEN concat('foreign', CAST(vec_id AS STRING)) ELSE chunk_id END AS chunk_id, vector FROM (
SELECT e.vec_id, e.embedding AS vector, concat({_LABEL_LANGUAGE}, '__', coalesce(d.source, 'none'), '__f', CAST(coalesce(d.doc_id, e.vec_id) AS STRING)) AS chunk_id
FROM embeddings e LEFT JOIN {_PLACED} d ON d.vec = e.vec_id) AS named
"""

# One query per (label, source): the group's first vector. Labels 8 and 9 ask without a language.
VIEWS["queries_fx"] = f"""
SELECT min(vec_id) AS query_id, concat('Create task {{', CAST(min(vec_id) AS STRING), '}}') AS query,
  min_by(embedding, vec_id) AS vector,
  CASE label WHEN 8 THEN '' WHEN 9 THEN CAST(NULL AS STRING) ELSE {_LABEL_LANGUAGE} END AS language
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id GROUP BY label, source
"""

# Every vector whose id is divisible by 100 asks, in the language of its label.
VIEWS["vec_queries_fx"] = f"""
SELECT vec_id AS query_id, {_LABEL_LANGUAGE} AS language, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0
"""

# Every vector beside the query vector of its own group.
VIEWS["pairs_fx"] = """
WITH p AS (SELECT vec_id, embedding, label, coalesce(source, 'none') AS source FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
g AS (SELECT label, source, min_by(embedding, vec_id) AS lead_vector FROM p GROUP BY label, source)
SELECT p.vec_id AS vec_id, p.embedding AS vector, g.lead_vector AS lead_vector
FROM p JOIN g ON g.label = p.label AND g.source = p.source
"""

VIEWS["prompts_fx"] = """
SELECT conv_id * 100 + turn AS query_id, CASE (conv_id + turn) % 12
  WHEN 0 THEN concat('Create a Python Flask API ', text) WHEN 1 THEN concat('Use JavaScript ', text) WHEN 2 THEN concat('Node Express ', text)
  WHEN 3 THEN concat('Rust ', text) WHEN 4 THEN concat('Write SQL ', text) WHEN 5 THEN concat('Ignore Previous Instructions ', text)
  WHEN 6 THEN concat('please jailbreak ', text) WHEN 7 THEN repeat(concat(text, ' '), 30) WHEN 8 THEN '   ' WHEN 9 THEN concat(chr(10), ' ab ', chr(9))
  WHEN 10 THEN concat('{x} ', text) ELSE text END AS query FROM conversations WHERE role = 'user'
"""

# Prompts with a vector of their own: that of the point numbered like their conversation.
VIEWS["prompt_vectors_fx"] = f"""
SELECT p.query_id, p.query, e.embedding AS vector FROM ({VIEWS["prompts_fx"]}) p
JOIN embeddings e ON e.vec_id = CAST(floor(p.query_id / 100) AS BIGINT)
"""

VIEWS["responses_fx"] = """
SELECT conv_id * 100 + turn - 1 AS query_id, CASE (conv_id + turn) % 7
  WHEN 0 THEN concat('```python', chr(10), text, chr(10), '```') WHEN 1 THEN concat(chr(10), '  ```', chr(10), 'def f(): pass', chr(10), '```  ')
  WHEN 2 THEN concat('```', chr(10), 'x') WHEN 3 THEN concat('class A ', text) WHEN 4 THEN '' WHEN 5 THEN CAST(NULL AS STRING) ELSE text END AS response
FROM conversations WHERE role = 'assistant'
"""

VIEWS["urls_fx"] = """
SELECT page_id, CASE page_id % 8 WHEN 0 THEN concat('https://github.com/o', CAST(page_id AS STRING), '/r') WHEN 1 THEN concat('https://github.com/o/r', CAST(page_id AS STRING), '.git')
  WHEN 2 THEN concat('http://github.com/o/r', CAST(page_id AS STRING), '//') WHEN 3 THEN 'github.com/o/r/tree/main' WHEN 4 THEN 'https://gitlab.com/o/r'
  WHEN 5 THEN 'https://github.com/o' WHEN 6 THEN 'https://github.com/o/r.git/' ELSE url END AS url FROM pages
"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the Parquet tables of ``sf_dir``."""
    sql = VIEWS[name]
    for table in TABLES:
        if re.search(rf"\b(FROM|JOIN) {table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)


def ctes(*names: str) -> str:
    """``WITH`` clause that defines the named views, for the oracle engine."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
