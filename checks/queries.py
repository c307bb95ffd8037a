"""Registered queries: ``(spark, sf_dir) -> DataFrame`` over the whole given tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trovelight.functions import vectors
from trovelight.functions.sql_functions import register_sql_functions
from trovelight.functions.paths import flattened_name, has_tokens
from trovelight.operators import bounded_search, token_index
from trovelight.operators import (
    chunking, embedding, interactions, inventory, packing, search, selection, upsert,
)
from trovelight.plans.answer_prompts import answer_prompts, pack_answers
from trovelight.plans.build_corpus import build_corpus, select_raw_files
from trovelight.plans import inventory_repos
from trovelight.plans.inventory_repos import inventory_roots
from trovelight.session import cut_lineage, new_folder, stored
from trovelight.settings import Settings
from trovelight.sources import chunks as chunk_io
from trovelight.sources.files import scan_raw_files, write_files
from trovelight.sources.vector_table import VectorTable
from trovelight.streaming.chunk_load import start_chunk_load
from trovelight.streaming.prompt_answers import start_prompt_answers

from .fixtures import view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
THRESHOLD = 0.2  # no two different vectors of the given tables reach the default


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _raw_files(spark: SparkSession, sf: str) -> DataFrame:
    named = flattened_name(F.col("owner"), F.col("repo_name"), F.col("path"))
    return view(spark, sf, "files_fx").select(named.alias("file_name"), "code")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.with_language(_raw_files(spark, sf))


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files_fx").withColumn("size_bytes", F.octet_length("code").cast("long"))


def _ids(column: str = "chunk_ids"):
    return F.array_join(column, "|").alias(column)


# --- search and packing --------------------------------------------------------------

@query
def context_pack(spark, sf):
    packed = pack_answers(view(spark, sf, "queries_fx"), view(spark, sf, "vec_fx"), threshold=THRESHOLD)
    return packed.select("query_id", "prompt", F.col("packed").cast("long").alias("packed"), _ids())


def _scores(hits):
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id",
                       F.round("score", 6).alias("score"))


@query
def vector_topk(spark, sf):
    return _scores(search.best_hits(view(spark, sf, "queries_fx"), view(spark, sf, "vec_fx"), threshold=THRESHOLD))


@query
def vector_topk_blocks(spark, sf):
    """The same search with the queries sent in many small blocks."""
    return _scores(search.best_hits(
        view(spark, sf, "queries_fx"), view(spark, sf, "vec_fx"), threshold=THRESHOLD,
        block_bytes=64 << 10))


@query
def vector_topk_unfiltered(spark, sf):
    queries = view(spark, sf, "queries_fx").withColumn("language", F.lit(None).cast("string"))
    return _scores(search.best_hits(queries, view(spark, sf, "vec_fx"), threshold=THRESHOLD))


@query
def vector_topk_l2(spark, sf):
    return _scores(search.best_hits(view(spark, sf, "queries_fx"), view(spark, sf, "vec_fx"), metric="l2"))


@query
def bounded_topk(spark, sf):
    """vector_topk's contract, every vector with an id divisible by 100 asking; cells skipped by bounds."""
    store = bounded_search.write_cells(view(spark, sf, "vec_fx"))
    hits, _ = bounded_search.bounded_top_k(view(spark, sf, "vec_queries_fx"), store, k=5, threshold=THRESHOLD)
    return _scores(hits)


@query
def vector_scores(spark, sf):
    a, b = F.col("vector"), F.col("lead_vector")
    return view(spark, sf, "pairs_fx").select(
        "vec_id", F.round(vectors.norm(a), 6).alias("norm"), F.round(vectors.dot(a, b), 6).alias("dot"),
        F.round(vectors.cosine(a, b), 6).alias("cosine"), F.round(vectors.squared_l2(a, b), 6).alias("squared_l2"))


def _hits(spark, sf, points=None):
    points = view(spark, sf, "vec_fx") if points is None else points
    return search.search(view(spark, sf, "queries_fx"), points, threshold=THRESHOLD)


@query
def hit_preview(spark, sf):
    shown = packing.preview_hits(_hits(spark, sf))
    return shown.withColumn("rank", F.col("rank").cast("long"))


@query
def hit_ids(spark, sf):
    hits = search.best_hits(view(spark, sf, "queries_fx"), view(spark, sf, "vec_fx"), threshold=THRESHOLD)
    return packing.hit_ids(hits).select("query_id", _ids())


@query
def hits_in_repo(spark, sf):
    points = view(spark, sf, "vec_fx")
    hits = _hits(spark, sf, points.filter(has_tokens(F.col("path"), "SRC7")))
    return _scores(hits)


@query
def token_search(spark, sf):
    """Points by tokens of their path: their own number and repository, then a foreign one."""
    points = view(spark, sf, "vec_fx")
    return points.select(
        "chunk_id", has_tokens(F.col("path"), "src7").alias("in_src7"),
        has_tokens(F.col("repo"), "src").alias("partial_token"))


#: Questions asked of the token index: (field, text). Lists of the whole table are built.
INDEX_QUESTIONS = (("path", "SRC7"), ("repo", "src"), ("repo", "SRC1"), ("path", "src3__30"), ("path", "30 src3"), ("path", ""))


@query
def indexed_tokens(spark, sf):
    """Points whose field holds every token asked, answered from inverted lists only."""
    points = view(spark, sf, "vec_fx")
    index = token_index.open_index(spark, token_index.build_token_index(points, ("repo", "path")))
    found = None
    for field, asked in INDEX_QUESTIONS:
        part = token_index.lookup(index, field, asked).select(
            F.lit(field).alias("field"), F.lit(asked).alias("asked"), F.col("point_id").alias("chunk_id"))
        found = part if found is None else found.unionByName(part)
    return found


# --- chunking --------------------------------------------------------------------------

def _chunk_rows(chunks):
    return chunks.withColumn("ordinal", F.col("ordinal").cast("long"))


@query
def chunks_regex(spark, sf):
    return _chunk_rows(chunking.regex_chunks(_files(spark, sf)))


@query
def chunks_default(spark, sf):
    return _chunk_rows(chunking.whole_file_chunks(_files(spark, sf)))


@query
def chunks_python(spark, sf):
    return _chunk_rows(chunking.python_chunks(_files(spark, sf)))


@query
def chunks_javascript(spark, sf):
    return _chunk_rows(chunking.javascript_chunks(_files(spark, sf)))


@query
def chunks_all(spark, sf):
    return _chunk_rows(chunking.chunk_files(_raw_files(spark, sf)))


@query
def chunk_ids(spark, sf):
    return chunking.latest_chunks(chunking.chunk_files(_raw_files(spark, sf))).select("chunk_id", "path")


def _loads(spark, sf):
    """A first load of all chunks; a second that revises three languages and repeats the whole files."""
    first = chunking.chunk_files(_raw_files(spark, sf))
    revised = first.filter(F.col("language").isin("go", "ruby", "python")).withColumn(
        "code", F.concat("code", F.lit("\n// revised")))
    return first, revised.unionByName(first.filter(F.col("function_name") == "default"))


@query
def chunk_upsert(spark, sf):
    first, second = (chunking.latest_chunks(x) for x in _loads(spark, sf))
    return upsert.upsert(first, cut_lineage(second)).select("chunk_id", "language", "path", "code")


@query
def last_write_wins(spark, sf):
    first, second = _loads(spark, sf)
    loads = first.withColumn("seq", F.lit(0)).unionByName(second.withColumn("seq", F.lit(1)))
    return upsert.last_by_key(loads, "chunk_id", F.struct("seq", "path", "ordinal")).select(
        "chunk_id", "language", "path", "code")


@query
def load_counts(spark, sf):
    first, second = _loads(spark, sf)
    merged = upsert.upsert(chunking.latest_chunks(first), chunking.latest_chunks(second))
    return upsert.load_counts(second, merged)


# --- inventory -------------------------------------------------------------------------

def _inventory(spark, sf):
    return inventory.file_inventory(view(spark, sf, "files_fx"))


@query
def file_inventory(spark, sf):
    return _inventory(spark, sf).select(
        "owner", "repo_name", "path", "language", "extension", "size_bytes", "line_count",
        "is_test_file", "is_entry_point", "is_supported", "is_indexed")


@query
def repo_totals(spark, sf):
    return inventory.repo_totals(_inventory(spark, sf))


@query
def repo_languages(spark, sf):
    return inventory.repo_languages(_inventory(spark, sf)).select(
        "owner", "repo_name", F.explode("languages").alias("language", "files"))


@query
def repo_documents(spark, sf):
    files = F.transform("files", lambda f: F.concat_ws(":", f.path, f.language, f.line_count.cast("string")))
    return inventory.repo_documents(_inventory(spark, sf)).select(
        "owner", "repo_name", "total_files", "indexed_files",
        F.size(F.map_keys("languages")).cast("long").alias("languages"),
        F.array_join(F.array_sort(files), "|").alias("files"))


@query
def repo_records(spark, sf):
    """Sessions of all repositories with their totals and each indexed file."""
    files = view(spark, sf, "files_fx")
    sessions = files.select("owner", "repo_name").distinct().select(
        F.concat_ws("/", "owner", "repo_name").alias("url"), F.concat_ws("/", "owner", "repo_name").alias("local_path"))
    listed = inventory.file_inventory(files).withColumn("root", F.concat_ws("/", "owner", "repo_name"))
    return inventory_repos.repo_records(sessions, listed).select(
        "url", "total_files", "indexed_files", "path", "line_count")


@query
def parse_repo_url(spark, sf):
    return inventory.parse_urls(view(spark, sf, "urls_fx"))


# --- selection -------------------------------------------------------------------------

@query
def select_repos(spark, sf):
    chosen = selection.select_repos(view(spark, sf, "repos_fx"))
    return chosen.withColumn("rank", F.col("rank").cast("long"))


@query
def select_files(spark, sf):
    chosen = selection.select_files(_tree(spark, sf), max_files=2)
    return chosen.withColumn("position", F.col("position").cast("long"))


@query
def corpus_files(spark, sf):
    """Selected repositories, their first files, and the text of those."""
    settings = Settings(MAX_REPOS=8, MAX_FILES_PER_REPO=3)
    files = view(spark, sf, "files_fx")
    return select_raw_files(view(spark, sf, "file_repos_fx"), _tree(spark, sf), files, settings)


def _scraped(spark, sf):
    return selection.candidate_files(_tree(spark, sf)).withColumn(
        "file_name", flattened_name(F.col("owner"), F.col("repo_name"), F.col("path")))


@query
def scrape_summary(spark, sf):
    return selection.scrape_summary(_scraped(spark, sf))


@query
def languages_pending(spark, sf):
    return selection.pending_languages(spark, _scraped(spark, sf), required_repos=2)


# --- prompts ---------------------------------------------------------------------------

@query
def validate_prompts(spark, sf):
    return interactions.validate_prompts(view(spark, sf, "prompts_fx")).select(
        "query_id", "is_valid", "reason", "message")


@query
def infer_language(spark, sf):
    return interactions.accept_prompts(view(spark, sf, "prompts_fx")).select("query_id", "language")


@query
def clean_responses(spark, sf):
    return interactions.clean_responses(view(spark, sf, "responses_fx"))


def _records(spark, sf):
    prompts = interactions.accept_prompts(view(spark, sf, "prompt_vectors_fx"))
    hits = search.best_hits(prompts, view(spark, sf, "vec_fx"), threshold=THRESHOLD)
    return interactions.interaction_records(prompts, view(spark, sf, "responses_fx"), packing.hit_ids(hits))


@query
def interaction_log(spark, sf):
    return _records(spark, sf).select(
        "query_id", "query", "language", "response", "kind", "display_language", _ids())


# --- embedding -------------------------------------------------------------------------

def _places(embedded, *keys):
    """The places of a vector that are not zero, a row each."""
    rows = embedded.select(*keys, F.posexplode("vector").alias("place", "value")).where("value <> 0")
    return rows.select(*keys, F.col("place").cast("long").alias("place"),
                       F.round(F.col("value").cast("double"), 6).alias("value"))


@query
def embed_corpus(spark, sf):
    chunks = chunking.chunk_files(_raw_files(spark, sf))
    return _places(embedding.embed_chunks(chunks, embedding.HashingEncoder(64)), "chunk_id")


@query
def embed_prompts(spark, sf):
    prompts = view(spark, sf, "prompts_fx")
    return _places(embedding.embed_prompts(prompts, embedding.HashingEncoder(64)), "query_id")


@query
def encoder_fallback(spark, sf):
    """The first encoder that loads embeds; one that does not is passed over."""

    def absent():
        raise ImportError("no such model")

    encoder = embedding.first_available([embedding.Encoder("absent", absent), embedding.HashingEncoder(64)])
    embedded = embedding.embed_prompts(view(spark, sf, "prompts_fx"), encoder)
    return _places(embedded.withColumn("encoder", F.lit(encoder.name)), "encoder", "query_id")


@query
def vector_payload_join(spark, sf):
    """Payload and vectors from two tables; ids without a partner drop out."""
    joined = embedding.attach_vectors(view(spark, sf, "vec_fx").drop("vector"), view(spark, sf, "vectors_fx"))
    return joined.select("chunk_id", "language", F.round(vectors.norm(F.col("vector")), 6).alias("norm"))


# --- sources and sinks -----------------------------------------------------------------

@query
def source_scan(spark, sf):
    """Write every file to disk, list the tree again and take its inventory."""
    root = new_folder(spark, "tree")
    write_files(view(spark, sf, "files_fx"), root, content="code")
    listed = inventory_roots(spark.createDataFrame([(root,)], "root string"))
    return listed.select("path", "language", "extension", "size_bytes", "line_count",
                         "is_test_file", "is_entry_point", "is_supported", "is_indexed")


@query
def raw_scan(spark, sf):
    """Write selected files as <language>/<name>, scan them back and chunk them."""
    root = new_folder(spark, "raw")
    named = _scraped(spark, sf).withColumn("target", F.concat_ws("/", "language", "file_name"))
    write_files(named, root, path="target", content="code")
    return _chunk_rows(chunking.chunk_files(scan_raw_files(spark, root)))


@query
def sink_roundtrip(spark, sf):
    path = new_folder(spark, "chunks")
    chunk_io.write_chunks(chunking.chunk_files(_raw_files(spark, sf)), path)
    return chunk_io.read_chunks(spark, path)


@query
def dataset_export(spark, sf):
    path = new_folder(spark, "chunks")
    chunk_io.write_chunks(chunking.chunk_files(_raw_files(spark, sf)), path)
    saved = new_folder(spark, "dataset")
    samples = chunk_io.export_dataset(chunk_io.load_chunk_dataset(spark, path), saved)
    return spark.read.parquet(saved).groupBy("language").agg(
        F.count(F.lit(1)).alias("chunks"), F.lit(samples).cast("long").alias("samples"))


@query
def vector_table(spark, sf):
    """Two loads through the table, then what a reader sees."""
    encoder = embedding.HashingEncoder(64)
    table = VectorTable.create(spark, new_folder(spark, "table"), encoder.dim, encoder=encoder.name)
    for load in _loads(spark, sf):
        table.load(embedding.embed_chunks(load, encoder), order=F.struct("path", "ordinal"))
    return table.read().select("chunk_id", "language", "path", "code")


@query
def vector_table_search(spark, sf):
    """Points loaded into a table and compacted, then searched there."""
    table = VectorTable.create(spark, new_folder(spark, "table"), 64)
    table.load(view(spark, sf, "vec_fx"))
    table.compact()
    return _scores(table.search(view(spark, sf, "queries_fx"), threshold=THRESHOLD))


@query
def flat_l2_index(spark, sf):
    table = VectorTable.create(spark, new_folder(spark, "table"), 64, metric="l2")
    table.load(view(spark, sf, "vec_fx"))
    return _scores(table.search(view(spark, sf, "queries_fx"), payload=()))


@query
def corpus_build(spark, sf):
    """Chunk, store, embed and load the whole corpus."""
    encoder = embedding.HashingEncoder(64)
    table = VectorTable.create(spark, new_folder(spark, "table"), encoder.dim, encoder=encoder.name)
    build_corpus(_raw_files(spark, sf), table, new_folder(spark, "chunks"), encoder)
    return table.read().select("chunk_id", "language", "repo", "path", "function_name")


@query
def log_append(spark, sf):
    path = new_folder(spark, "log")
    chunk_io.append_interactions(_records(spark, sf), path)
    stored = "query string, language string, response string, chunk_ids array<string>"
    return spark.read.schema(stored).json(path).select("query", "language", "response", _ids())


@query
def point_count(spark, sf):
    """A load counted and checked: the right number passes, any other is an error."""
    encoder = embedding.HashingEncoder(64)
    table = VectorTable.create(spark, new_folder(spark, "table"), encoder.dim, encoder=encoder.name)
    loaded = table.load(embedding.embed_chunks(chunking.chunk_files(_raw_files(spark, sf)), encoder))
    points = table.check_count(loaded.rows)
    try:
        table.check_count(points + 1)
        differs = False
    except ValueError:
        differs = True
    counted = table.read().agg(F.count(F.lit(1)).alias("points"))
    return counted.withColumn("differs_is_error", F.lit(differs))


# --- streaming -------------------------------------------------------------------------

@query
def stream_upsert(spark, sf):
    """All raw files through the streaming load; the table must equal the batch chunks."""
    source = new_folder(spark, "incoming")
    _raw_files(spark, sf).write.parquet(source)
    encoder = embedding.HashingEncoder(64)
    table = VectorTable.create(spark, new_folder(spark, "table"), encoder.dim, encoder=encoder.name)
    incoming = spark.readStream.schema("file_name string, code string").parquet(source)
    start_chunk_load(incoming, table, new_folder(spark, "checkpoint"), encoder).awaitTermination()
    return table.read().select("chunk_id", "path")


@query
def stream_after_batch(spark, sf):
    """A batch load, then two streams with checkpoints of their own, one of them run again."""
    encoder = embedding.HashingEncoder(64)
    table = VectorTable.create(spark, new_folder(spark, "table"), encoder.dim, encoder=encoder.name)
    files = _raw_files(spark, sf)
    part = F.pmod(F.xxhash64("file_name"), F.lit(3))
    build_corpus(files.where(part == 0), table, new_folder(spark, "chunks"), encoder)
    for n in (1, 2):
        source, checkpoint = new_folder(spark, "incoming"), new_folder(spark, "checkpoint")
        files.where(part == n).write.parquet(source)
        incoming = spark.readStream.schema("file_name string, code string").parquet(source)
        for _ in range(n):
            start_chunk_load(incoming, table, checkpoint, encoder).awaitTermination()
    return table.read().select("chunk_id", "path")


def _points(spark: SparkSession, sf: str, encoder) -> DataFrame:
    """The embedded corpus, stored: a search reads it for scores and again for the payload."""
    chunks = chunking.latest_chunks(chunking.chunk_files(_raw_files(spark, sf)))
    return stored(embedding.embed_chunks(chunks, encoder), "points")


@query
def stream_prompts(spark, sf):
    """All prompts as a stream against the embedded corpus."""
    encoder = embedding.HashingEncoder(64)
    points = _points(spark, sf, encoder)
    source, out = new_folder(spark, "prompts"), new_folder(spark, "answers")
    view(spark, sf, "prompts_fx").write.parquet(source)
    incoming = spark.readStream.schema("query_id long, query string").parquet(source)
    start_prompt_answers(incoming, points, out, new_folder(spark, "checkpoint"), encoder,
                         threshold=THRESHOLD).awaitTermination()
    return spark.read.parquet(out).select("query_id", "language", "prompt", _ids())


@query
def prompt_answers(spark, sf):
    """The same answers from the batch plan."""
    encoder = embedding.HashingEncoder(64)
    points = _points(spark, sf, encoder)
    return answer_prompts(view(spark, sf, "prompts_fx"), points, encoder, threshold=THRESHOLD).select(
        "query_id", "language", "prompt", _ids())


# --- SQL functions ---------------------------------------------------------------------

def _sql(spark, sf, text: str, *views: str) -> DataFrame:
    """``text`` in plain SQL over the named fixture views, with the library's SQL functions."""
    register_sql_functions(spark)
    for name in views:
        view(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(text)


@query
def sql_parse_repo_url(spark, sf):
    return _sql(spark, sf, """SELECT page_id, url, p.owner AS owner, p.name AS name, p.is_valid AS is_valid
        FROM (SELECT page_id, url, tl_parse_repo_url(url) AS p FROM urls_fx)""", "urls_fx")


@query
def sql_infer_language(spark, sf):
    return _sql(spark, sf, "SELECT query_id, tl_infer_language(query) AS language FROM prompts_fx", "prompts_fx")


@query
def sql_chunk_id(spark, sf):
    return _sql(spark, sf, """SELECT chunk_id AS point, tl_chunk_id(language, repo, path, function_name, code) AS id
        FROM vec_fx""", "vec_fx")
