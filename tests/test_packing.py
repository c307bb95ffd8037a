from trovelight.functions import prompts
from trovelight.operators import packing

HITS = "query_id long, rank int, score double, chunk_id string, language string, repo string, path string, function_name string, code string"


LITERAL = {  # code to snippet
    "x": "### [GO] r/p\nFunction: f\n```go\nx\n```",
    "\n".join(["l"] * 50): "### [GO] r/p\nFunction: f\n```go\n" + "l\n" * 50 + "```",
    "\n".join(["l"] * 51): "### [GO] r/p\nFunction: f\n```go\n" + "l\n" * 50 + "...\n# Code truncated for brevity\n```",
}


def test_snippets_are_literal(spark):
    hits = [(i, 1, 0.9, "a", "go", "r", "p", "f", code) for i, code in enumerate(LITERAL)]
    rows = packing.pack_context(spark.createDataFrame(hits, HITS)).collect()
    assert {r["query_id"]: r["context"] for r in rows} == dict(enumerate(LITERAL.values()))


def test_context_is_the_longest_prefix_that_fits(spark):
    """Sizes around the budget of 12,000 characters; a snippet's frame takes 41 of them."""
    frame, budget = 41, 12_000
    sizes = {1: [100, 200, 300], 2: [11_000, 800, 200], 3: [6_000, 5_918, 1], 4: [6_000, 5_919, 1], 5: [budget - frame, 0],
             6: [budget - frame + 1, 0], 7: [5_000, 9_000, 10], 8: [0] * 5}
    fits = {1: 3, 2: 2, 3: 2, 4: 1, 5: 1, 6: 0, 7: 1, 8: 5}
    hits = [(q, n + 1, 1.0, f"id{q}-{n}", "go", "repo", "path", "f", "x" * size) for q, many in sizes.items() for n, size in enumerate(many)]
    rows = {r["query_id"]: r for r in packing.pack_context(spark.createDataFrame(hits, HITS).repartition(4)).collect()}
    for q, many in sizes.items():
        assert rows[q]["packed"] == fits[q], q
        assert len(rows[q]["context"]) == sum(s + frame for s in many[:fits[q]]) <= budget
        assert rows[q]["chunk_ids"] == [f"id{q}-{n}" for n in range(len(many))]  # also those the budget left out


def test_a_first_snippet_over_budget_keeps_the_query(spark):
    hits = [(1, 1, 0.9, "a", "go", "r", "p", "f", "x" * 13_000), (1, 2, 0.8, "b", "go", "r", "p", "f", "y")]
    frame = spark.createDataFrame(hits, HITS)
    row = packing.pack_context(frame).first()
    assert (row["context"], row["packed"], row["chunk_ids"]) == ("", 0, ["a", "b"])


def test_prompt_text(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, "a", "go", "r", "p", "f", "code {x}")], HITS)
    queries = spark.createDataFrame([(1, "do {this}"), (2, "no hits")], "query_id long, query string")
    rows = packing.build_prompts(queries, packing.pack_context(hits)).collect()
    assert len(rows) == 1
    assert rows[0]["prompt"] == (
        "You are an expert developer.\n\nUse the following code snippets to generate a solution for the task.\n\n"
        "# CODE CONTEXT:\n### [GO] r/p\nFunction: f\n```go\ncode {x}\n```\n\n# TASK:\ndo this\n\n# INSTRUCTIONS:\n"
        "- Analyze the provided code examples for patterns and best practices\n"
        "- Generate clean, well-documented, and efficient code\n"
        "- Include appropriate error handling and edge cases\n"
        "- Add helpful comments explaining the logic\n"
        "- Generate high-quality, production-level code\n\n# RESPONSE:\n")


def test_preview_and_ids(spark):
    hits = spark.createDataFrame([(1, r, 0.5, f"c{r}", "go", "r", "p", "f", "x" * 400) for r in (4, 2, 1, 3)], HITS)
    shown = packing.preview_hits(hits).orderBy("rank").collect()
    assert [r["title"] for r in shown] == ["1. r / p", "2. r / p", "3. r / p"]
    assert shown[0]["preview"] == "x" * 300 + "..."
    assert packing.hit_ids(hits).first()["chunk_ids"] == ["c1", "c2", "c3", "c4"]


def test_truncation_needs_a_positive_limit():
    import pytest

    with pytest.raises(ValueError):
        prompts.truncate_snippet(None, 0)
