import numpy as np
import pytest
from pyspark.sql import functions as F

from trovelight.functions import vectors
from trovelight.operators import embedding, interactions
from trovelight.plans.answer_prompts import answer_prompts


def letters():
    seen = []

    def encode(texts):
        seen.append(len(texts))
        assert len(texts) <= 32
        return np.array([[t.count("a"), t.count("b"), len(seen) * 0 + 1] for t in texts], dtype=float)

    return encode


def broken():
    raise OSError("no weights here")


def rows(spark, *codes):
    return spark.createDataFrame(list(enumerate(codes)), "id int, code string")


def test_hashing_encoder(spark):
    frame = embedding.embed_chunks(rows(spark, "Foo bar(foo)", "foo BAR foo", "other", "", None), embedding.HashingEncoder(64))
    got = {r["id"]: r["vector"] for r in frame.select("id", "vector").collect()}
    assert all(len(v) == 64 for v in got.values()) and got[0] == got[1] != got[2]
    norms = {r["id"]: r["n"] for r in frame.select("id", vectors.norm(F.col("vector")).alias("n")).collect()}
    assert norms[0] == pytest.approx(1, abs=1e-6) and norms[3] == norms[4] == 0
    word = embedding.embed_chunks(rows(spark, "Größe", "größe;"), embedding.HashingEncoder(64)).select("vector").collect()
    assert word[0] == word[1] and sum(x > 0 for x in word[0]["vector"]) == 1
    assert sorted(x for x in got[0] if x)[-1] == pytest.approx(2 / 5 ** 0.5, abs=1e-6)  # foo twice, bar once


def test_model_encoder_keeps_rows_and_batches(spark):
    frame = embedding.embed_chunks(rows(spark, *["ab" * (i % 5) for i in range(300)]), embedding.Encoder("letters", letters))
    got = frame.orderBy("id").collect()
    assert [r["vector"] for r in got] == [[i % 5, i % 5, 1.0] for i in range(300)] and got[7]["code"] == "abab"


def test_prompts_are_encoded_by_query(spark):
    prompts = spark.createDataFrame([(1, "aab")], "query_id long, query string")
    assert embedding.embed_prompts(prompts, embedding.Encoder("letters", letters)).first()["vector"] == [2.0, 1.0, 1.0]


def test_first_encoder_that_loads_is_taken():
    good = embedding.Encoder("letters", letters)
    assert embedding.first_available([embedding.Encoder("x", broken), good]) is good
    with pytest.raises(RuntimeError, match="no weights here"):
        embedding.first_available([embedding.Encoder("x", broken)])
    assert embedding.first_available(embedding.default_encoders()).name


def test_vectors_that_arrive_separately(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, code string")
    vecs = spark.createDataFrame([("b", [1.0]), ("z", [2.0])], "chunk_id string, vector array<float>")
    assert [tuple(r) for r in embedding.attach_vectors(chunks, vecs).collect()] == [("b", "y", [1.0])]


def test_prompt_path(spark):
    """Invalid prompts and prompts without hits leave no answer; the log keeps every hit id."""
    schema = "chunk_id string, language string, repo string, path string, function_name string, code string, vector array<float>"
    corpus = spark.createDataFrame(
        [("p1", "python", "r", "p", "f", "flask api " + "x" * 13_000, None), ("g1", "go", "r", "p", "f", "golang flask api", None)],
        schema).drop("vector")
    encoder = embedding.HashingEncoder(64)
    points = embedding.embed_chunks(corpus, encoder)
    prompts = spark.createDataFrame(
        [(1, "python flask api {x}"), (2, "hi"), (3, "rust zebra quilt"), (4, "jailbreak flask api"), (5, "flask api golang")],
        "query_id long, query string")
    got = {r["query_id"]: r for r in answer_prompts(prompts, points, encoder, threshold=0.3).collect()}
    assert set(got) == {1, 5} and got[1]["language"] == "python"
    assert got[1]["chunk_ids"] == ["p1"] and got[1]["packed"] == 0 and "flask api x\n" in got[1]["prompt"]
    responses = spark.createDataFrame([(1, " ```py\ndef f(): pass\n``` "), (9, "x")], "query_id long, response string")
    accepted = interactions.accept_prompts(prompts)
    hits = spark.createDataFrame([(1, ["p1", "p2"])], "query_id long, chunk_ids array<string>")
    records = interactions.interaction_records(accepted, responses, hits, at=F.timestamp_seconds(F.lit(0))).collect()
    assert len(records) == 1
    assert (records[0]["response"], records[0]["kind"], records[0]["language"]) == ("def f(): pass", "code", "python")
    assert records[0]["chunk_ids"] == ["p1", "p2"] and records[0]["timestamp"].year == 1970


def test_log_append(spark, tmp_path):
    import json

    from trovelight.sources.chunks import append_interactions

    record = spark.createDataFrame([("q é", None, "r", ["a"])], "query string, language string, response string, chunk_ids array<string>")
    for _ in range(2):
        append_interactions(record.withColumn("timestamp", F.timestamp_seconds(F.lit(0))), str(tmp_path / "log"))
    lines = [json.loads(x) for p in (tmp_path / "log").glob("part-*") for x in p.read_text(encoding="utf8").splitlines()]
    assert len(lines) == 2 and lines[0]["language"] is None
    assert (lines[0]["query"], lines[0]["chunk_ids"]) == ("q é", ["a"]) and lines[0]["timestamp"].startswith("1970-01-01T00:00:00")
