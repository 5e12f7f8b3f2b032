"""Changes to a script's text at places that its syntax tree names. All else stays as it is written."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

from .pycode import parsed

NEWLINE = re.compile(rb"\r\n|\r|\n")
COMMENT = re.compile(rb"#[^\r\n]*")


class Script:
    """A script's bytes and tree; `tree` is None if it doesn't parse. Places in the tree are lines and UTF-8 columns."""

    def __init__(self, code: str):
        self.code, self.tree, self.raw = code, parsed(code), code.encode("utf-8", "surrogatepass")
        self.lines = [0, *(m.end() for m in NEWLINE.finditer(self.raw))]

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.lines[node.lineno - 1] + node.col_offset, self.lines[node.end_lineno - 1] + node.end_col_offset

    def calls(self, wanted: Callable[[ast.Call], bool]) -> Iterator[ast.Call]:
        """Calls from the outermost inwards."""
        return (n for n in ast.walk(self.tree) if isinstance(n, ast.Call) and wanted(n)) if self.tree is not None else iter(())

    def changed(self, edits: list[tuple[int, int, str]]) -> str:
        """The code with the texts of some spans replaced, which don't overlap."""
        raw = self.raw
        for start, end, text in sorted(edits, reverse=True):
            raw = raw[:start] + text.encode() + raw[end:]
        return raw.decode("utf-8", "surrogatepass") if edits else self.code

    def argument(self, call: ast.Call, text: str) -> tuple[int, int, str]:
        """The edit that adds an argument behind the others. A comma that is there already, before a comment maybe, is used."""
        end = self.span(call)[1] - 1
        given = [*call.args, *(k.value for k in call.keywords)]
        if not given:
            return end, end, text
        gap = COMMENT.sub(b"", self.raw[max(self.span(x)[1] for x in given) : end])
        return end, end, text if b"," in gap else f", {text}"

    def keyword(self, call: ast.Call, name: str, value: str) -> tuple[int, int, str]:
        """The edit that gives a keyword a value, whether the call has it or not."""
        for k in call.keywords:
            if k.arg == name:
                return *self.span(k.value), value
        return self.argument(call, f"{name}={value}")


def call_of(name: str) -> Callable[[ast.Call], bool]:
    """Whether a call is of a dotted name."""
    return lambda call: ast.unparse(call.func) == name


def in_first_call(code: str, wanted: Callable[[ast.Call], bool], edit: Callable[[Script, ast.Call], tuple[int, int, str]], in_text_order: bool = False) -> str:
    script = Script(code)
    found = sorted(script.calls(wanted), key=script.span) if in_text_order else list(script.calls(wanted))
    return script.changed([edit(script, found[0])]) if found else code
