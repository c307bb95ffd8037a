"""Function declarations of a JavaScript source file.

A search jumps from one bracket, quote, slash or ``function`` to the next; a stack of
open brackets closes each ``function name(...) {...}`` at its own brace. What precedes
``function`` tells a declaration from an expression.
"""

from __future__ import annotations

import re
from typing import Iterator

_WORD = r"[\w$\u0080-\U0010ffff]"
# Each of these can match a given text in one way only, so a failure costs no more than a success.
_SKIP = r"(?:\s|/\*(?:[^*]|\*(?!/))*\*/|//[^\n\r\u2028\u2029]*(?=[\n\r\u2028\u2029]|\Z))*"
_STOP = re.compile(rf"""["'`/(){{}}\[\]]|(?<![\w$.#\u0080-\U0010ffff])function(?!{_WORD})""")
_HEAD = re.compile(rf"function{_SKIP}(?P<name>(?!\d){_WORD}+){_SKIP}\(")
_BODY = re.compile(rf"{_SKIP}\{{")
_STRING = re.compile(r"""(["'])(?:(?!\1)[^\\\n]|\\[\s\S])*\1""")
_COMMENT = re.compile(r"//[^\n\r\u2028\u2029]*|/\*[\s\S]*?(?:\*/|\Z)")
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
_TEMPLATE = re.compile(r"[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*)*(`|\$\{|\Z)")
_TAIL = re.compile(rf"(?:{_WORD}+|=>|\+\+|--|\S)\Z")
_CASE = re.compile(r"\s*(?:case\b|default\s*\Z)")

_CLOSES = {")": "(", "]": "[", "}": "{"}
_OPERAND = '"'  # stands for a string, template or regular expression just read
# Words that want an operand next, so ``function`` after them is an expression.
_BEFORE_OPERAND = frozenset(
    "return typeof new in of void delete throw await yield case instanceof extends".split())
_BEFORE_STATEMENT = frozenset("else do export default".split())


class _Scan:
    def __init__(self, code: str):
        self.code = code
        self.last, self.last_end, self.newline = "", 0, True
        self.no_regex_before = 0  # no regular expression starts before this place
        self.stack: list[tuple[str, tuple | None]] = []
        self.found: list[tuple[int, int, str]] = []

    def run(self) -> Iterator[tuple[str, str]]:
        at, size = 0, len(self.code)
        while at < size:
            if self.stack and self.stack[-1][0] == "`":
                at = self.template(at)
                continue
            stop = _STOP.search(self.code, at)
            if stop is None:
                break
            at = self.token(stop.group(), stop.start())
        for begin, end, name in sorted(self.found):
            yield name, self.code[begin:end]

    def consumed(self, token: str, end: int) -> int:
        self.last, self.last_end, self.newline = token, end, False
        return end

    def before(self, at: int) -> tuple[str, bool]:
        """The token before ``at``, and whether a line break lies between."""
        gap = self.code[self.last_end:at]
        text = gap.rstrip()
        broken = "\n" in gap[len(text):] or "\r" in gap[len(text):]
        if not text:
            return self.last, broken or self.newline
        return _TAIL.search(text[-64:]).group(), broken

    def token(self, text: str, at: int) -> int:
        if text == "function":
            return self.function(at)
        if text in "\"'":
            string = _STRING.match(self.code, at)
            return self.consumed(_OPERAND, string.end()) if string else self.consumed(text, at + 1)
        if text == "/":
            return self.slash(at)
        if text in _CLOSES:
            return self.close(text, at)
        self.stack.append((text, None))
        return self.consumed(text, at + 1)

    def slash(self, at: int) -> int:
        comment = _COMMENT.match(self.code, at)
        previous, broken = self.before(at)
        if comment:  # leaves the token before it in place
            self.consumed(previous, comment.end())
            self.newline = broken or "\n" in comment.group()
            return comment.end()
        # After "<" a slash closes a markup tag.
        if _wants_operand(previous) and previous != "<" and at >= self.no_regex_before:
            literal = _REGEX.match(self.code, at)
            if literal:
                return self.consumed(_OPERAND, literal.end())
            line_end = self.code.find("\n", at)
            self.no_regex_before = line_end if line_end >= 0 else len(self.code)
        return self.consumed("/", at + 1)

    def template(self, at: int) -> int:
        piece = _TEMPLATE.match(self.code, at)
        if piece is None:
            return len(self.code)
        if piece.group(1) == "${":
            self.stack.append(("${", None))
            return self.consumed("(", piece.end())
        self.stack.pop()
        return self.consumed(_OPERAND, piece.end())

    def function(self, at: int) -> int:
        head = _HEAD.match(self.code, at)
        begin = at
        previous, broken = self.before(at)
        if previous == "async" and not broken:
            begin = self.code.rfind("async", 0, at)
            previous, broken = self.before(begin)
        if head is None or not self.is_statement(previous, broken, begin):
            return self.consumed("function", at + len("function"))
        self.stack.append(("(", ("parameters", begin, head["name"])))
        return self.consumed("(", head.end())

    def is_statement(self, previous: str, broken: bool, at: int) -> bool:
        if previous in ("", ";", "{", "}", ")") or previous in _BEFORE_STATEMENT:
            return True
        if previous == ":":
            colon = self.code.rfind(":", 0, at)
            opened = max(self.code.rfind(mark, 0, colon) for mark in ";{}")
            return _CASE.match(self.code, opened + 1, colon) is not None
        if previous == "return" or not _wants_operand(previous):
            return broken  # a new line ends the statement before it
        return False

    def close(self, text: str, at: int) -> int:
        """Pop to the bracket ``text`` closes; an unmatched closer changes nothing."""
        for depth in range(len(self.stack) - 1, -1, -1):
            mark, owner = self.stack[depth]
            if mark == _CLOSES[text] or (mark == "${" and text == "}"):
                del self.stack[depth:]
                return self.closed(owner, text, at + 1)
            if mark == "${":
                break
        return self.consumed(text, at + 1)

    def closed(self, owner: tuple | None, text: str, end: int) -> int:
        if owner is not None:
            part, begin, name = owner
            if part == "body":
                self.found.append((begin, end, name))
            else:
                body = _BODY.match(self.code, end)
                if body:
                    self.stack.append(("{", ("body", begin, name)))
                    return self.consumed("{", body.end())
        return self.consumed(text, end)


def _wants_operand(previous: str) -> bool:
    if previous in (_OPERAND, ")", "]", "++", "--"):
        return False
    if previous and re.match(_WORD, previous):
        return previous in _BEFORE_OPERAND or previous in _BEFORE_STATEMENT
    return True


def javascript_functions(code: str) -> Iterator[tuple[str, str]]:
    """``(name, source)`` of each function declaration, nested ones included, outer first.

    Arrow functions, methods, generators and function expressions are left out, as is
    a declaration whose body never closes.
    """
    return _Scan(code).run() if "function" in code else iter(())
