"""Function definitions of a Python source file."""

from __future__ import annotations

import ast
import re
import warnings
from collections import deque
from typing import Iterator

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")


def python_functions(code: str) -> Iterator[tuple[str, str]]:
    """``(name, source)`` of each def, sync or async, at any depth, level by level.

    The source runs from ``def`` (decorators left out) to the end of the body. Text
    that does not parse yields nothing.
    """
    if "def" not in code:
        return
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code)
    except Exception:
        return
    lines: list[bytes] | None = None
    level = deque([tree])
    while level:
        node = level.popleft()
        level.extend(ast.iter_child_nodes(node))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if lines is None:  # split once per file; positions are byte offsets into lines
                lines = [line.encode() for line in _LINE.findall(code)]
            yield node.name, _segment(lines, node)


def _segment(lines: list[bytes], node: ast.AST) -> str:
    first, last = node.lineno - 1, node.end_lineno - 1
    if first == last:
        return lines[first][node.col_offset:node.end_col_offset].decode()
    body = [lines[first][node.col_offset:], *lines[first + 1:last], lines[last][:node.end_col_offset]]
    return b"".join(body).decode()
