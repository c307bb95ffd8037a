"""Row-level expressions against examples and against the same rule in plain Python."""

import hashlib
import io
from pathlib import PurePosixPath

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trovelight import fixed_values as fixed
from trovelight.functions import languages, paths, prompts, text, urls, vectors
from trovelight.functions.chunk_id import chunk_id

ANY_TEXT = st.text(alphabet=st.sampled_from(list("ab `{}\n\r\t\x0b\x0c\x1c\x1e\x85 é\U0001f600/.")), max_size=60)
RELAXED = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def col(build):
    return lambda name: build(F.col(name))


# --- repository urls -------------------------------------------------------------------

URLS = {
    "https://github.com/tiangolo/fastapi": ("tiangolo", "fastapi"),
    "https://github.com/tiangolo/fastapi.git": ("tiangolo", "fastapi"),
    "https://github.com/tiangolo/fastapi/": ("tiangolo", "fastapi"),
    "github.com/o/r/tree/main": ("o", "r"),
    "http://github.com/o/r.git///": ("o", "r"),
    "https://github.com/o/r.git.git": ("o", "r.git"),
    "https://github.com//r": ("", "r"),
    "https://gitlab.com/owner/repo": None,
    "https://github.com/owner": None,
    "https://GitHub.com/o/r": None,
    "a://github.com/o/r://x": ("o", "r:"),
    "": None,
    None: None,
}


def test_repo_urls(evaluate):
    got = evaluate(list(URLS), col(urls.parse_repo_url))
    for url, row in zip(URLS, got):
        expected = URLS[url]
        assert row["is_valid"] is (expected is not None), url
        assert (row["owner"], row["name"]) == (expected or (None, None)), url


def test_repo_url_strict_mode_raises(evaluate):
    with pytest.raises(PySparkException):
        evaluate(["https://gitlab.com/o/r"], lambda c: urls.parse_repo_url(F.col(c), strict=True))


# --- paths -----------------------------------------------------------------------------

def test_ignored_paths(evaluate):
    ignored = ["node_modules/lodash/index.js", "src/__pycache__/module.cpython-310.pyc",
               "src/module.pyc", "assets/logo.png", "src/LOGO.PNG", "build", "a/.env", "x/target"]
    kept = ["src/main.py", "src/api/routes/auth.py", "Node_Modules/a.js", "src/builder.py", "png"]
    assert evaluate(ignored + kept, col(paths.is_ignored)) == [True] * len(ignored) + [False] * len(kept)


def test_test_files(evaluate):
    tests = ["tests/test_auth.py", "src/auth_test.go", "tests/integration/test_db.py", "latest_run.py",
             "a/Tests/x.py", "a\\spec\\b.js", "my_spec.rb"]
    others = ["src/api/auth.py", "tests/conftest.py", "spec/a.rb"]
    assert evaluate(tests + others, col(paths.is_test_file)) == [True] * len(tests) + [False] * len(others)


def test_entry_points(evaluate):
    names = ["main.py", "app.py", "manage.py", "Main.java", "utils.py", "main.java", "MAIN.py"]
    assert evaluate(names, col(paths.is_entry_point)) == [True, True, True, True, False, False, False]


def test_suffix_is_pathlibs(evaluate):
    names = [".gitignore", "a.tar.gz", "..foo", "a", "a.PY", ".a.b", "x y.js", "a..b", "é.é"]
    assert evaluate(names, col(paths.suffix)) == [PurePosixPath(n).suffix for n in names]


def test_last_dot_part_stands_for_endswith(evaluate):
    names = [".py", "a/.py", "a.py", "apy", "a.py/b", "x.d.ts", "a.PY"]
    tails = evaluate(names, col(paths.last_dot_part))
    for ext in fixed.EXTENSION_LANGUAGE:
        assert [t == ext for t in tails] == [n.endswith(ext) for n in names]


def test_tokens(evaluate):
    names = ["src7__12", "SRC7/x", "src77", "a-src7", None]
    assert evaluate(names, lambda c: paths.has_tokens(F.col(c), "Src7"))[:4] == [True, True, False, True]
    assert evaluate(["a b c", "a c", "b"], lambda c: paths.has_tokens(F.col(c), "c, a")) == [True, True, False]


def test_name_tokens(evaluate):
    names = ["o__r__a.py", "plain", "o__r"]
    assert evaluate(names, col(paths.repo_token)) == ["o", "plain", "o"]
    assert evaluate(names, col(paths.second_token)) == ["r", None, "r"]


# --- languages -------------------------------------------------------------------------

def test_language_lookup(evaluate):
    assert evaluate([".py", ".ts", ".R", ".xyz", ""], col(languages.language_of)) == [
        "python", "typescript", "r", None, None]
    assert evaluate([".py", ".PY", ".R", ".r"], col(languages.language_of_exact)) == ["python", None, None, "r"]


PROMPTS = {
    "Create a Python Flask API for login": "python",
    "Build a Java Spring Boot application": "java",
    "Create a Node.js Express server": "javascript",
    "Write a SQL query for PostgreSQL joins": "sql",
    "Build a login system": None,
    "Use JavaScript": "java",
    "copy a file": "python",
    "C# service": "csharp",
}


def test_infer_language(evaluate):
    assert evaluate(list(PROMPTS), col(languages.infer_language)) == list(PROMPTS.values())


# --- text ------------------------------------------------------------------------------

@RELAXED
@given(st.lists(ANY_TEXT, min_size=10, max_size=60))
def test_strip_and_lines_follow_python(evaluate, values):
    assert evaluate(values, col(text.strip)) == [v.strip() for v in values]
    assert evaluate(values, col(text.count_lines)) == [
        sum(1 for _ in io.TextIOWrapper(io.BytesIO(v.encode()), encoding="utf-8")) for v in values]
    stripped = [v.strip() for v in values if v.strip()]
    if stripped:
        assert evaluate(stripped, col(text.split_lines)) == [v.splitlines() for v in stripped]


def test_line_count_examples(evaluate):
    assert evaluate(["line1\nline2\nline3\n", "", "a\r\nb\rc", "x"], col(text.count_lines)) == [3, 0, 3, 1]


def test_bad_utf8_is_dropped(evaluate):
    assert evaluate([bytes.fromhex("6162ff6364c3a9"), b"", b"\xe2\x82"], col(text.decode_utf8), "binary") == [
        "abcdé", "", ""]


# --- prompts and responses ---------------------------------------------------------------

VERDICTS = [
    (None, "empty"), ("", "empty"), (" \n\t", "empty"), (" ab ", "too_short"), ("abcde", "ok"),
    (" abcd" + " " * 495, "too_short"), (" abcd" + " " * 496, "too_short"), (" abcde" + " " * 494, "ok"), ("x" * 501, "too_long"),
    ("please JAILBREAK it", "restricted"), ("Act as System now", "restricted"), ("jail break", "ok"), ("é" * 500, "ok"),
]


def test_prompt_verdicts(evaluate):
    got = evaluate([q for q, _ in VERDICTS], col(prompts.prompt_verdict))
    assert got == [v for _, v in VERDICTS]
    assert evaluate(got, col(prompts.verdict_message)) == [fixed.PROMPT_MESSAGES[v] for v in got]


RESPONSES = [
    (None, ""), ("  plain text \n", "plain text"), ("```python\nx = 1\n```", "x = 1"), ("```\n  a\n\n b \n```  ", "a\n\n b"),
    ("```\nx", "```\nx"), ("```", "```"), ("```\r\na\r\nb\r\n```", "a\nb"), ("text\n```\nx\n```", "text\n```\nx\n```"),
    ("```py\na\n```\nafter", "a\n```"),
]


def test_clean_response(evaluate):
    assert evaluate([r for r, _ in RESPONSES], col(prompts.clean_response)) == [c for _, c in RESPONSES]


@RELAXED
@given(st.lists(ANY_TEXT, min_size=10, max_size=60))
def test_cleaning_text_without_a_fence_only_trims_it(evaluate, values):
    plain = [v for v in values if not v.strip().startswith("```")]
    if plain:
        assert evaluate(plain, col(prompts.clean_response)) == [v.strip() for v in plain]


def test_response_kind(evaluate):
    assert evaluate(["def f", "a class A", "the function", "defer", ""], col(prompts.response_kind)) == [
        "code", "code", "code", "markdown", "markdown"]
    assert evaluate(["go", "", None], col(prompts.display_language)) == ["go", "text", "text"]


SNIPPETS = [
    ("a", "a"), ("a\nb", "a\nb"), ("a\nb\nc", "a\nb\n...\n# Code truncated for brevity"),
    ("\n\n\n", "\n\n...\n# Code truncated for brevity"), ("", ""), ("a\rb\rc", "a\rb\rc"),
]


def test_truncate_snippet(evaluate):
    assert evaluate([c for c, _ in SNIPPETS], lambda c: prompts.truncate_snippet(F.col(c), 2)) == [s for _, s in SNIPPETS]


def test_snippet_defaults(evaluate):
    empty = F.lit(None).cast("string")
    render = lambda c: prompts.render_snippet(F.col(c), empty, empty, empty, empty)
    assert evaluate([None, "go"], render) == [
        "### [TEXT] unknown/\nFunction: \n```text\n\n```", "### [GO] unknown/\nFunction: \n```go\n\n```"]


def test_braces_and_preview(evaluate):
    assert evaluate(["{a}{{b}"], col(prompts.strip_braces)) == ["ab"]
    assert evaluate(["x" * 301, None], col(prompts.preview_code)) == ["x" * 300 + "...", "..."]


# --- ids and vectors ---------------------------------------------------------------------

IDS = [  # computed once with md5sum
    (("go", "r", "p", "f", "code"), "go__r__f__" + hashlib.md5(b"go_r_p_f_code").hexdigest()[:10]),
    (("c", "", "", "", ""), "c____" + "__" + hashlib.md5(b"c____").hexdigest()[:10]),
]


def test_chunk_id(spark):
    frame = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(IDS)], "i int, a string, b string, c string, d string, e string")
    got = frame.select("i", chunk_id(*[F.col(c) for c in "abcde"]).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == [y for _, y in IDS]


def test_chunk_id_sees_the_first_200_characters_only(spark):
    frame = spark.createDataFrame([("x" * 200,), ("x" * 200 + "y",), ("x" * 199 + "y",)], "e string")
    one = F.lit("a")
    a, b, c = (r["y"] for r in frame.select(chunk_id(one, one, one, one, F.col("e")).alias("y")).collect())
    assert a == b != c


def test_vector_arithmetic(spark):
    frame = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = frame.select(vectors.norm(a).alias("n"), vectors.cosine(a, b).alias("c"), vectors.squared_l2(a, b).alias("l")).collect()
    assert [tuple(r) for r in got] == [(5.0, 0.96, 2.0), (0.0, 0.0, 2.0)]
