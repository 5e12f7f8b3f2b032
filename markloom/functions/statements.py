"""A script read by its top-level statements, so that a rewritten script costs what has changed in it.

Statements that are read alone and begin at a line's first column make a script that is read, unless something reaches
from one to another (`apart`). A statement is known by its shape, its text without what is in plain strings and numbers,
on which neither its syntax tree nor whether it compiles depends. What isn't sure this way is read as a whole.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from functools import lru_cache

from . import pycode
from .edits import Script

TOP = re.compile(r"\n(?=\S)")
#: Each branch begins with the characters it may begin with, so that a search can skip others.
LITERAL = re.compile(r"""('[^'\n]*'|"[^"\n]*"|[1-9](?<![\w.].)\d{0,8}(?:\.\d{1,9})?(?![\w.])|0(?<![\w.].)\.\d{1,9}(?![\w.]))""")
#: Where LITERAL may take something else for a string, or where a literal's value counts (patterns).
UNSURE = re.compile(r"\\|'''|\"\"\"|case")
#: Strings of these prefixes hold code.
PREFIXED = re.compile(r"[fFrRtT]'")


class Kept(dict):
    """What was found, by text; emptied when the texts come to `most` characters."""

    def __init__(self, most: int = 4_000_000):
        super().__init__()
        self.most = self.size = most

    def put(self, key, text: str, value):
        self.size -= len(text) + 200
        if self.size < 0:
            self.clear()
            self.size = self.most
        self[key] = value
        return value


_texts, _shapes, _calls = Kept(), Kept(), Kept()


@lru_cache(64)
def shaped(text: str) -> tuple[str, list[str]] | None:
    """A statement's shape, and its text in pieces, each second of them a literal. None: it has no sure shape."""
    if UNSURE.search(text):
        return None
    pieces = LITERAL.split(text)
    marks = ["1" if p[0].isdigit() else "'" for p in pieces[1::2]]
    key = pieces.copy()
    key[1::2] = marks
    shape = "".join(key)
    if "#" in shape or '"' in shape or shape.count("'") != marks.count("'") or PREFIXED.search(shape):
        return None
    return shape, pieces


def _compiles(text: str) -> bool:
    """Whether a statement compiles alone."""
    known = _texts.get(text)
    if known is None:
        if text[:1] == "#" and text.isprintable():
            return True
        shape = shaped(text)
        known = _shapes.get(shape[0]) if shape else None
        if known is None:
            known = pycode.compiles(text + "\n")
            if shape:
                _shapes.put(shape[0], shape[0], known)
        _texts.put(text, text, known)
    return known


def apart(code: str) -> list[str] | None:
    """A script's top-level statements, if it surely compiles as each of them does; they are joined by newlines."""
    if not code.isascii() or "\r" in code or "\\\n" in code or "global" in code or "__future__" in code:
        return None
    texts = TOP.split(code)
    for text in texts:
        if not _texts.get(text) and not _compiles(text):
            return None
    return texts


def compiles(code: str) -> bool:
    """As `pycode.compiles`."""
    return apart(code) is not None or pycode.compiles(code)


def rewritten(code: str, mark: str, rewrite: Callable[[str], str]) -> str:
    """rewrite(code), for one that changes each statement by its own text, and only where a name `mark` is."""
    if mark not in code and code.isascii():
        return code
    texts = apart(code)
    return rewrite(code) if texts is None else "\n".join(rewrite(t) if mark in t else t for t in texts)


def first_call(texts: list[str], names: tuple[str, ...]) -> tuple[int, str] | None:
    """Where the first, outermost call of one of the names takes one more argument, in the joined texts, and what stands before that."""
    best, at = None, 0
    for text in texts:
        for name in names:
            if name in text:
                found = _first_call(text, names)
                if found and (best is None or found[0] < best[0]):
                    best = found[0], at + found[1], found[2]
                break
        at += len(text) + 1
    return best and best[1:]


def _first_call(text: str, names: tuple[str, ...]) -> tuple[int, int, str] | None:
    """Of one statement, with the call's depth."""
    if (text, names) in _calls:
        return _calls[text, names]
    shape = shaped(text)
    key = (names, shape[0]) if shape else (text, names)
    if key in _calls:
        if _calls[key] is None:
            return _calls.put((text, names), text, None)
        depth, piece, at, before = _calls[key]
        return depth, sum(map(len, shape[1][:piece])) + at, before
    script, found = Script(text), None
    level, depth = [script.tree], 0
    while level and found is None:
        for node in level:
            if isinstance(node, ast.Call) and pycode.called(node) in names:
                at, _, before = script.argument(node, "")
                found = depth, at, before
                break
        level, depth = [below for node in level for below in ast.iter_child_nodes(node)], depth + 1
    kept = found
    if found and shape:
        piece, at = 0, found[1]
        while at >= len(shape[1][piece]):
            at -= len(shape[1][piece])
            piece += 1
        kept = found[0], piece, at, found[2]
    _calls.put(key, text, kept)
    return found
