from pyspark.sql import functions as F

from trovelight.operators import chunking
from trovelight.operators.embedding import HashingEncoder, embed_chunks
from trovelight.plans.answer_prompts import answer_prompts
from trovelight.sources.vector_table import VectorTable
from trovelight.streaming.chunk_load import start_chunk_load
from trovelight.streaming.prompt_answers import start_prompt_answers


def test_files_that_arrive_later_are_loaded_once(spark, tmp_path):
    encoder = HashingEncoder(16)
    table = VectorTable.create(spark, str(tmp_path / "t"), 16, encoder=encoder.name)
    inbox = str(tmp_path / "inbox")
    schema = "file_name string, code string"

    def arrive(*files):
        spark.createDataFrame(list(files), schema).coalesce(1).write.mode("append").parquet(inbox)

    def load():
        stream = spark.readStream.schema(schema).parquet(inbox)
        start_chunk_load(stream, table, str(tmp_path / "cp"), encoder).awaitTermination()
        return {(r["path"], r["function_name"]) for r in table.read().collect()}

    arrive(("o__r__a.go", "func a() { }"), ("o__r__b.py", "def f(): pass"))
    assert load() == {("o__r__a.go", "func_0"), ("o__r__b.py", "f")}
    arrive(("o__r__a.go", "func a() { }"), ("o__r__c.sql", "x"))
    assert load() == {("o__r__a.go", "func_0"), ("o__r__b.py", "f"), ("o__r__c.sql", "default")}
    before = table._state()
    load()
    assert table._state() == before


def test_streams_share_a_table_with_batch_loads(spark, tmp_path):
    encoder = HashingEncoder(16)
    table = VectorTable.create(spark, str(tmp_path / "t"), 16, encoder=encoder.name)
    schema = "file_name string, code string"
    frame = lambda name: spark.createDataFrame([(f"o__r__{name}.sql", "x")], schema)
    table.load(embed_chunks(chunking.chunk_files(frame("batch")), encoder))
    for n in ("one", "two"):
        frame(n).write.parquet(str(tmp_path / n))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / n))
        start_chunk_load(stream, table, str(tmp_path / f"cp-{n}"), encoder).awaitTermination()
    assert {r["path"] for r in table.read().collect()} == {f"o__r__{n}.sql" for n in ("batch", "one", "two")}


def test_answers_and_logs_of_several_streams_stay(spark, tmp_path):
    encoder = HashingEncoder(64)
    raw = spark.createDataFrame([("o__r__a.sql", "select users from table")], "file_name string, code string")
    points = embed_chunks(chunking.chunk_files(raw), encoder)
    schema = "query_id long, query string"
    for n in (1, 2):
        spark.createDataFrame([(n, "sql select users")], schema).write.parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{n}"))
        start_prompt_answers(
            stream, points, str(tmp_path / "out"), str(tmp_path / f"cp{n}"), encoder, threshold=0.1, log=str(tmp_path / "log"),
            respond=lambda answers: answers.select("query_id", F.lit("def f(): pass").alias("response"))).awaitTermination()
    assert {r["query_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 2}
    records = spark.read.json(str(tmp_path / "log")).collect()
    assert {r["query_id"] for r in records} == {1, 2} and {r["kind"] for r in records} == {"code"}


def test_prompt_stream_equals_the_batch_plan(spark, tmp_path):
    encoder = HashingEncoder(64)
    raw = spark.createDataFrame([("o__r__a.sql", "select users from table"), ("o__r__b.lua", "print users table")],
                                "file_name string, code string")
    points = embed_chunks(chunking.chunk_files(raw), encoder)
    prompts = spark.createDataFrame([(1, "sql select users"), (2, "no"), (3, "list the users table")], "query_id long, query string")
    prompts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, query string").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        start_prompt_answers(stream, points, str(tmp_path / "out"), str(tmp_path / "cp"), encoder, threshold=0.1).awaitTermination()
    columns = ["query_id", "language", "prompt", "chunk_ids"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()
    expected = answer_prompts(prompts, points, encoder, threshold=0.1).select(*columns).collect()
    assert len(got) == 2 and sorted(map(str, got)) == sorted(map(str, expected))
