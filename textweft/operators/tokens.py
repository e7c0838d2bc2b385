"""Tokenizers: a file's content becomes a sequence of named tokens with regions (zero-based row, byte column; end exclusive).

The character tokenizer is vectorised over Arrow batches. Tree tokenizers give a parser's nodes in pre-order: ``(``, the node's
kind, its children, ``)``; names of identifiers never appear, so renaming leaves no trace.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np

REGION = "struct<start_row:int,start_col:int,end_row:int,end_col:int>"


class Token(NamedTuple):
    name: str
    start_row: int
    start_col: int
    end_row: int
    end_col: int


class Chars(NamedTuple):
    """Character tokens of several texts: offset of each token's bytes, its text, row, byte column and bytes."""

    lead: np.ndarray
    owner: np.ndarray
    row: np.ndarray
    col: np.ndarray
    size: np.ndarray


def char_tokens(data: np.ndarray, offsets: np.ndarray) -> Chars:
    """A token per code point of each line. A line ends with a line feed, before which a carriage return belongs to the ending."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Chars(none, none, none, none, none)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(lead, n))
    first = np.searchsorted(lead, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    byte = data[lead]
    feed = byte == 10
    gone = feed
    if len(back := np.flatnonzero(byte == 13)):
        back = back[back + 1 < len(lead)]
        gone = feed.copy()
        gone[back[feed[back + 1] & (owner[back + 1] == owner[back])]] = True
    # a line begins after a line feed and where a text begins
    starts = np.union1d(np.flatnonzero(feed) + 1, first)
    starts = starts[starts < len(lead)]
    lines = np.diff(np.append(starts, len(lead)))
    number, text = np.arange(len(starts)), owner[starts]
    number -= np.searchsorted(text, text)
    row, col = np.repeat(number, lines), lead - np.repeat(lead[starts], lines)
    token = np.flatnonzero(~gone)
    return Chars(lead[token], owner[token], row[token], col[token], size[token])


class Node(NamedTuple):
    """A node of a syntax tree, in a language-independent form. ``children`` are the named ones."""

    kind: str
    start: tuple[int, int]
    end: tuple[int, int]
    children: list[Node]


def tree_tokens(root: Node, include_comments: bool = False) -> list[Token]:
    """Serialises a tree without recursion. A node whose kind has ``comment`` in it is skipped with all below, if so wished.

    ``(`` and the kind reach from the node's start to its first named child, which may be a skipped comment, or to its end; ``)`` is
    empty and stands at its end.
    """
    out: list[Token] = []
    stack: list[Node | Token] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, Token):
            out.append(node)
            continue
        if not include_comments and "comment" in node.kind.lower():
            continue
        head = node.children[0].start if node.children else node.end
        out += [Token("(", *node.start, *head), Token(node.kind, *node.start, *head)]
        stack.append(Token(")", *node.end, *node.end))
        stack += reversed(node.children)
    return out


def python_tree(source: str) -> Node:
    """The syntax tree of Python source by the standard library's parser; expression contexts and operators are no nodes."""
    lines = source.split("\n")

    def place(row: int, col: int) -> tuple[int, int]:
        return (row - 1, col)

    def build(node: ast.AST, at: tuple[int, int], upto: tuple[int, int]) -> Node:
        start = place(node.lineno, node.col_offset) if hasattr(node, "lineno") else at
        end = place(node.end_lineno, node.end_col_offset) if getattr(node, "end_lineno", None) else upto
        children: list[Node] = []
        position = start
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
                continue
            made = build(child, position, position)
            children.append(made)
            position = made.end
        return Node(type(node).__name__, start, max(end, start), children)

    return build(ast.parse(source), (0, 0), (len(lines) - 1, len(lines[-1].encode())))


class _HtmlTree(HTMLParser):
    """Elements, text and comments of a page as nodes."""

    _VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=False)
        self.lines = source.split("\n")
        end = (len(self.lines) - 1, len(self.lines[-1].encode()))
        self.stack: list[tuple[str, tuple[int, int], list[Node]]] = [("document", (0, 0), [])]
        self.feed(source)
        self.close()
        while len(self.stack) > 1:
            self._pop(end)
        kind, start, children = self.stack[0]
        self.root = Node(kind, start, end, children)

    def _here(self) -> tuple[int, int]:
        row, col = self.getpos()
        return row - 1, len(self.lines[row - 1][:col].encode())

    def _pop(self, end: tuple[int, int]) -> None:
        kind, start, children = self.stack.pop()
        self.stack[-1][2].append(Node(kind, start, end, children))

    def _leaf(self, kind: str) -> None:
        here = self._here()
        self.stack[-1][2].append(Node(kind, here, here, []))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        here = self._here()
        children = [Node("attribute", here, here, []) for _ in attrs]
        if tag in self._VOID:
            self.stack[-1][2].append(Node(f"element_{tag}", here, here, children))
        else:
            self.stack.append((f"element_{tag}", here, children))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        here = self._here()
        self.stack[-1][2].append(Node(f"element_{tag}", here, here, [Node("attribute", here, here, []) for _ in attrs]))

    def handle_endtag(self, tag: str) -> None:
        if any(k == f"element_{tag}" for k, *_ in self.stack[1:]):
            here = self._here()
            while self.stack[-1][0] != f"element_{tag}":
                self._pop(here)
            self._pop(here)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._leaf("text")

    def handle_comment(self, data: str) -> None:
        self._leaf("comment")


def html_tree(source: str) -> Node:
    """The element tree of a page; every element's kind has its tag."""
    return _HtmlTree(source).root


TREES = {"html": html_tree, "python": python_tree}


def tokenizer_for(language: str):
    """``content -> Iterator[Token]`` for a language that has a tree tokenizer; an error for others, never another tokenizer."""
    tree = TREES.get(language.lower())
    if tree is None:
        raise ValueError(f"there is no tokenizer for {language} here; 'char' takes any text, and trees exist for {', '.join(TREES)}")
    return tree


def tokens_of(content: str, language: str, include_comments: bool = False) -> list[Token]:
    return tree_tokens(tokenizer_for(language)(content), include_comments)


def char_tokens_of(content: str) -> Iterator[Token]:
    """Character tokens of one text, one at a time; the definition that ``char_tokens`` must agree with."""
    rows = content.split("\n")
    for i, line in enumerate(rows):
        if i < len(rows) - 1 and line.endswith("\r"):
            line = line[:-1]
        col = 0
        for c in line:
            size = len(c.encode())
            yield Token(c, i, col, i, col + size)
            col += size
