"""Fixed values.

Word lists, lookup tables, patterns, limits and text formats that decide results.
They are data, kept verbatim and in their meaningful order; the logic that uses
them lives in ``functions`` and ``operators``.
"""

from __future__ import annotations

# --- file extension -> language (case-sensitive keys) ---------------------------
EXTENSION_LANGUAGE: dict[str, str] = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".java": "java",
    ".cpp": "cpp",
    ".c": "c",
    ".cs": "csharp",
    ".go": "go",
    ".rs": "rust",
    ".php": "php",
    ".rb": "ruby",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".sql": "sql",
    ".html": "html",
    ".css": "css",
    ".sh": "bash",
    ".m": "objective-c",
    ".jl": "julia",
    ".lua": "lua",
    ".dart": "dart",
    ".r": "r",
    ".pl": "perl",
    ".json": "json",
}

# --- inventory: path components that exclude a file ------------------------------
IGNORED_NAMES: tuple[str, ...] = (
    "node_modules", ".git", "__pycache__", ".venv", "venv",
    "env", ".env", "dist", "build", ".next", ".nuxt",
    "vendor", "target", ".gradle", ".idea", ".vscode",
    "coverage", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    "eggs", ".eggs", "htmlcov", "site-packages",
)

# --- inventory: lower-cased extensions that exclude a file -----------------------
IGNORED_EXTENSIONS: tuple[str, ...] = (
    ".pyc", ".pyo", ".pyd",
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".webp",
    ".pdf", ".zip", ".tar", ".gz", ".rar", ".7z",
    ".woff", ".woff2", ".ttf", ".eot",
    ".map", ".lock",
    ".bin", ".exe", ".dll", ".so", ".dylib",
    ".db", ".sqlite", ".sqlite3",
)

# --- inventory: substrings of a lower-cased path that mark a test file -----------
TEST_MARKERS: tuple[str, ...] = (
    "test_", "_test", "/tests/", "/test/", "/spec/", "_spec",
)

# --- inventory: file names that mark an entry point ------------------------------
ENTRY_POINT_NAMES: tuple[str, ...] = (
    "main.py", "app.py", "__main__.py", "manage.py", "wsgi.py",
    "asgi.py", "server.py", "run.py", "index.ts", "index.js",
    "main.ts", "main.js", "app.ts", "app.js", "server.ts",
    "main.go", "main.rs", "Main.java", "Program.cs",
)

# --- prompts: language keywords; the first language with any hit wins -------------
LANGUAGE_KEYWORDS: dict[str, tuple[str, ...]] = {
    "python": ("flask", "django", "pandas", "numpy", "python", "py"),
    "java": ("spring", "jdk", "java", "jvm"),
    "javascript": ("node", "express", "js", "javascript", "react"),
    "typescript": ("ts", "typescript", "nestjs"),
    "cpp": ("c++", "cpp", "stl"),
    "c": ("c ", "c-language", "c code"),
    "csharp": ("c#", "dotnet", "csharp"),
    "go": ("golang", "go "),
    "rust": ("rust",),
    "php": ("php", "laravel"),
    "ruby": ("ruby", "rails"),
    "bash": ("shell", "bash", "sh"),
    "kotlin": ("kotlin", "android"),
    "swift": ("swift", "ios"),
    "scala": ("scala",),
    "sql": ("sql", "database", "postgres", "mysql"),
}

# --- prompts: phrases that reject a prompt ---------------------------------------
BLOCKED_PHRASES: tuple[str, ...] = (
    "ignore previous instructions",
    "ignore all instructions",
    "reveal system prompt",
    "show hidden prompt",
    "disregard previous directions",
    "bypass security",
    "override instructions",
    "act as system",
    "jailbreak",
)

# --- prompts: length limits and the message shown for each verdict ----------------
PROMPT_MIN_CHARS = 5
PROMPT_MAX_CHARS = 500
PROMPT_MESSAGES: dict[str, str] = {
    "empty": "❌ Please enter a valid prompt.",
    "too_short": "❌ Prompt is too short.",
    "too_long": "❌ Prompt too long. Please keep it under 500 characters.",
    "restricted": "❌ Prompt contains restricted instructions that are not allowed.",
    "ok": "",
}

# --- responses: substrings that mark a response as code ---------------------------
CODE_RESPONSE_MARKERS: tuple[str, ...] = ("def ", "class ", "function")

# --- chunking: function patterns, in the syntax of Python's re module -------------
FUNCTION_PATTERNS: dict[str, str] = {
    "typescript": r"(function\s+\w+\(.*?\)\s*{[\s\S]*?})",
    "java": r"(public\s+.*?\s+\w+\(.*?\)\s*{[\s\S]*?})",
    "cpp": r"(\w+\s+\w+\s*\(.*?\)\s*{[\s\S]*?})",
    "c": r"(\w+\s+\w+\s*\(.*?\)\s*{[\s\S]*?})",
    "go": r"(func\s+\w+\(.*?\)\s*{[\s\S]*?})",
    "php": r"(function\s+\w+\(.*?\)\s*{[\s\S]*?})",
    "ruby": r"(def\s+\w+[\s\S]*?end)",
    "swift": r"(func\s+\w+\(.*?\)\s*{[\s\S]*?})",
    "rust": r"(fn\s+\w+\(.*?\)\s*{[\s\S]*?})",
    "csharp": r"(public\s+.*?\s+\w+\(.*?\)\s*{[\s\S]*?})",
    "kotlin": r"(fun\s+\w+\(.*?\)\s*{[\s\S]*?})",
    "scala": r"(def\s+\w+\(.*?\)\s*{[\s\S]*?})",
    "bash": r"(function\s+\w+\s*\(\)\s*{[\s\S]*?})",
}

# --- chunking: limits and id layout ------------------------------------------------
WHOLE_FILE_MAX_CHARS = 5000
WHOLE_FILE_NAME = "default"
MATCH_NAME_PREFIX = "func_"
ID_SEPARATOR = "__"
ID_HASH_SEPARATOR = "_"
ID_CODE_CHARS = 200
ID_HASH_CHARS = 10

# --- snippets: line cap, marker lines, defaults ------------------------------------
SNIPPET_MAX_LINES = 50
SNIPPET_TAIL = "\n...\n# Code truncated for brevity"
SNIPPET_DEFAULT_LANGUAGE = "text"
SNIPPET_DEFAULT_REPO = "unknown"
CONTEXT_MAX_CHARS = 12_000
PREVIEW_HITS = 3
PREVIEW_CHARS = 300
PREVIEW_TAIL = "..."

# --- prompt template ----------------------------------------------------------------
PROMPT_BEFORE_CONTEXT = """You are an expert developer.

Use the following code snippets to generate a solution for the task.

# CODE CONTEXT:
"""
PROMPT_BEFORE_TASK = """

# TASK:
"""
PROMPT_AFTER_TASK = """

# INSTRUCTIONS:
- Analyze the provided code examples for patterns and best practices
- Generate clean, well-documented, and efficient code
- Include appropriate error handling and edge cases
- Add helpful comments explaining the logic
- Generate high-quality, production-level code

# RESPONSE:
"""

# --- characters that Python treats as white space / as line boundaries --------------
PYTHON_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
PYTHON_LINE_BREAK_REGEX = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
