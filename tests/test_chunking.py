"""Chunking against the parser of the standard library and Python's own regular expressions."""

import ast
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from trovelight import fixed_values as fixed
from trovelight.operators import chunking
from trovelight.operators.javascript_functions import javascript_functions
from trovelight.operators.python_functions import python_functions

EXTENSION = {v: k for k, v in fixed.EXTENSION_LANGUAGE.items()}


def raw(spark, *pairs):
    return spark.createDataFrame([(f"o__r__{i}{ext}", code) for i, (ext, code) in enumerate(pairs)],
                                 "file_name string, code string")


def chunked(spark, *pairs, **options):
    rows = chunking.chunk_files(raw(spark, *pairs), **options).orderBy("path", "ordinal").collect()
    return [(r["function_name"], r["code"]) for r in rows]


def test_python_examples(spark):
    assert [n for n, _ in chunked(spark, (".py", '\ndef hello():\n    print("hello")\n'))] == ["hello"]
    assert [n for n, _ in chunked(spark, (".py", '\nasync def fetch_data():\n    return "done"\n'))] == ["fetch_data"]
    assert chunked(spark, (".py", "def broken(:")) == []


PYTHON_SOURCES = [
    "@deco\ndef f(x):\n    def g(): return 'é'\n    return g\n\nclass A:\n    async def h(self):\n        def k(): pass\n",
    "x = 1; s = 'ü'; \nif x:\r\n    def a(): return 'ñ'  # c\r\nelse:\r    def b(): pass\r",
    "def one(): return (lambda: 1)\ndef two(\n  a=1,\n): pass\x0c\ndef three(): 'tail'",
    "", "def", "x = '\x00'", "class C:\n  def m(self): ...\n  class D:\n    def n(self): ...\n",
    "def deep():\n" + "".join("  " * i + f"def n{i}():\n" for i in range(1, 30)) + "  " * 30 + "pass\n",
]


@pytest.mark.parametrize("source", PYTHON_SOURCES)
def test_python_matches_the_standard_library(source):
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        expected = []
    else:
        expected = [(n.name, ast.get_source_segment(source, n)) for n in ast.walk(tree)
                    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    assert list(python_functions(source)) == expected


JAVASCRIPT = {
    "function greet() {\n  console.log('hello');\n}": ["greet"],
    "function a() { function b() { } }": ["a", "b"],
    "const f = function named() {}; let g = () => { function deep() {} };": ["deep"],
    "async function af() { return `}${{a: 1}.a}` }\nfunction* gen() {}": ["af"],
    "export default function ex() {}\nexport default function () {}": ["ex"],
    "(function iife() { function inside() {} })();": ["inside"],
    "class A { m() { function inm() {} } static function() {} }": ["inm"],
    "switch (x) { case 1: function c1() {} default: function c2() {} }": ["c1", "c2"],
    "var o = { a: function no() {}, b() {} };": [],
    "const z = 1\nfunction after() { return 2 / 3 / 4 }": ["after"],
    "// function no() {}\n/* function no() {} */ 'function no() {}'; /function no() {}/.test(x)": [],
    "function s(a = '}', b = /[}/]/, c = `${'}'}`) { return \"{\" }": ["s"],
    "x = cond ? function no() {} : 1; if (x) function yes() {}": ["yes"],
    "function open() { if (x) {": [],
    "function App() { return <p>Don't {x}<b>{y}</b></p>; }\nfunction later() {}": ["App", "later"],
    "return\nfunction f() {}": ["f"],
    "functional(); my.function (x) {}; $function y() {}": [],
}


@pytest.mark.parametrize("source", JAVASCRIPT)
def test_javascript_declarations(source):
    found = list(javascript_functions(source))
    assert [n for n, _ in found] == JAVASCRIPT[source]
    for name, body in found:
        assert re.match(r"(async\s+)?function\s", body) and body.endswith("}") and body in source


def test_javascript_keeps_characters_whole(spark):
    source = "/* é😀 */ function grüß() { return 'ß' }"
    assert chunked(spark, (".js", source)) == [("grüß", "function grüß() { return 'ß' }")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("`'\"/*\\(){}[]$;:\n af") + ["function ", "async ", "${", "function f() {}"]), max_size=60).map("".join))
def test_javascript_never_fails(source):
    for name, body in javascript_functions(source):
        assert body in source and body.count("function") >= 1


def test_whole_files(spark):
    assert chunked(spark, (".sql", "print('hello world')")) == [("default", "print('hello world')")]
    assert chunked(spark, (".sql", "x" * 4999), (".sql", "x" * 5000), (".sql", "")) == [
        ("default", "x" * 4999), ("default", "")]
    assert chunked(spark, (".R", "x"), (".xyz", "x"), ("", "x")) == []


HARD = ["function a() { ", "/", "`${", "'", "(function a(){", "/* ", "a = b / c; ", "[/", "x/*", "\\"]


@pytest.mark.parametrize("piece", HARD)
def test_javascript_time_grows_with_length_only(piece):
    began = time.perf_counter()
    list(javascript_functions(piece * (200_000 // len(piece)) + " function"))
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("source", ["`" + "a$" * 5000 + "\\", "function " + "// " * 5000 + "x", "function " + "/* */ " * 5000 + ";",
                                    "function f(a) " + "/* */ // \n" * 5000 + ";", "'" + "\\" * 9999, "a=/" + "[a]" * 5000])
def test_javascript_failures_are_cheap(source):
    began = time.perf_counter()
    assert list(javascript_functions(source + " function")) == []
    assert time.perf_counter() - began < 5


def test_unclosed_functions_are_not_followed_to_the_end(spark):
    heads = "func a() {\n" * 50_000
    began = time.perf_counter()
    assert chunked(spark, (".go", "} " + heads)) == []
    assert [len(c) for _, c in chunked(spark, (".go", heads + "}"))] == [len(heads) + 1]
    assert time.perf_counter() - began < 60


# Words and white space beyond ASCII, line ends that only one engine knows, missing parts.
PIECES = ["function ", "func ", "fn ", "fun ", "def ", "public ", "static ", "int ", "naïve", "größe_1", "f²", "x", "(", ")",
          "{", "}", "()", "end", "\n", "\r", "\x85", "\xa0", chr(0x2028), chr(0x3000), "\x1f", " ", "‿", "é", "١", ";", "public void run(a) { x }"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), min_size=20, max_size=60))
def test_patterns_match_what_python_matches(spark, sources):
    languages = ("typescript", "java", "cpp", "go", "ruby", "rust", "kotlin", "scala", "bash")
    rows = [(language, "r", f"{language}{i}", source) for language in languages for i, source in enumerate(sources)]
    got = chunking.regex_chunks(spark.createDataFrame(rows, "language string, repo string, file_name string, code string"))
    expected = [(path, n, f"func_{n}", match) for language, _, path, source in rows
                for n, match in enumerate(re.findall(fixed.FUNCTION_PATTERNS[language], source))]
    assert sorted((r["path"], r["ordinal"], r["function_name"], r["code"]) for r in got.collect()) == sorted(expected)


def test_every_pattern_language_is_cut(spark):
    bodies = {"ruby": "def go\n 1\nend", "bash": "function go () {\n}"}
    words = {"java": "public void ", "csharp": "public void ", "go": "func ", "swift": "func ", "rust": "fn ", "kotlin": "fun ",
             "scala": "def ", "c": "int ", "cpp": "int ", "typescript": "function ", "php": "function "}
    sources = {lang: bodies.get(lang) or words[lang] + "go(a)\n{ x }" for lang in fixed.FUNCTION_PATTERNS}
    got = chunked(spark, *[(EXTENSION[lang], code) for lang, code in sources.items()])
    assert sorted(got) == sorted(("func_0", code) for code in sources.values())


def test_extractors_can_be_replaced(spark):
    words = lambda code: [(w, w) for w in code.split()]
    got = chunked(spark, (".sql", "a b"), (".lua", "<x><y>"), extractors={"sql": words, "lua": r"(<\w+>)"})
    assert sorted(got) == [("a", "a"), ("b", "b"), ("func_0", "<x>"), ("func_1", "<y>")]


def test_last_of_equal_ids_wins(spark):
    twice = "def f():\n  return 1\n"
    files = raw(spark, (".py", twice + twice), (".py", twice))
    chunks = chunking.chunk_files(files)
    assert chunks.count() == 3
    latest = chunking.latest_chunks(chunks)
    assert {(r["path"], r["ordinal"]) for r in latest.collect()} == {("o__r__0.py", 1), ("o__r__1.py", 0)}


def test_chunking_needs_no_shuffle_and_one_scan(spark, tmp_path):
    raw(spark, (".py", "def f(): pass"), (".go", "func f() { }")).write.parquet(str(tmp_path / "raw"))
    files = spark.read.parquet(str(tmp_path / "raw"))
    plan = chunking.chunk_files(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1
