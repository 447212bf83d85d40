"""A language-neutral tree: tokens, comments and nested brackets.

For languages without a grammar of their own here.  Regular-expression rules,
templates and bracket-level queries work on it; grammar node kinds do not exist.
Kinds: source_file, parentheses, braces, brackets, statement (a line or what a
semicolon ends, inside braces or at the top), identifier, number, string, comment.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .trees import Node, Tree

PAIRS = {"(": (")", "parentheses"), "{": ("}", "braces"), "[": ("]", "brackets")}


def lexer(line: str, block: tuple[str, str] | None, strings: str) -> re.Pattern[str]:
    parts = [f"(?P<comment>{line}[^\\n]*" + (f"|{re.escape(block[0])}.*?(?:{re.escape(block[1])}|\\Z)" if block else "") + ")"]
    quotes = [r'"""(?:.*?)"""'] if '"' in strings else []
    quotes += [rf"{q}(?:\\.|[^{q}\\\n])*{q}" for q in strings]
    parts.append("(?P<string>" + "|".join(quotes) + ")")
    parts.append(r"(?P<number>\d[\w.]*)|(?P<identifier>[^\W\d]\w*)|(?P<nl>\n)|(?P<op>->|=>|::|\.\.\.|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|[^\s\w])")
    return re.compile("|".join(parts), re.S)


def bracket_parser(line: str = "//", block: tuple[str, str] | None = ("/*", "*/"), strings: str = "\"'") -> Callable[[str], Tree]:
    lex = lexer(line, block, strings)

    def parse(code: str) -> Tree:
        root = Node("source_file", 0, len(code.encode()))
        stack: list[tuple[Node, list[Node], str]] = [(root, [], "")]
        at = pos = 0

        def end_statement() -> None:
            n, run, _ = stack[-1]
            if run:
                n.children.append(run[0] if len(run) == 1 and run[0].kind in ("comment", "braces") else Node("statement", run[0].start, run[-1].end, children=list(run)))
                run.clear()

        def put(x: Node) -> None:
            n, run, _ = stack[-1]
            (run if n.kind in ("source_file", "braces") else n.children).append(x)

        for m in lex.finditer(code):
            at += len(code[pos : m.start()].encode())
            size, pos, kind, text = len(m[0].encode()), m.end(), m.lastgroup, m[0]
            if kind == "nl":
                if stack[-1][0].kind in ("source_file", "braces"):
                    end_statement()
            elif kind != "op":
                put(Node(kind, at, at + size))
            elif text in PAIRS:
                n = Node(PAIRS[text][1], at, at + size, children=[Node(text, at, at + size, False)])
                put(n)
                stack.append((n, [], PAIRS[text][0]))
            elif text in ")}]":
                token = Node(text, at, at + size, False)
                if len(stack) > 1 and stack[-1][2] == text:
                    end_statement()
                    n = stack.pop()[0]
                    n.children.append(token)
                    n.end = token.end
                else:
                    token.error = True
                    put(token)
            else:
                put(Node(text, at, at + size, False))
                if text == ";" and stack[-1][0].kind in ("source_file", "braces"):
                    end_statement()
            at += size
        while len(stack) > 1:
            end_statement()
            n = stack.pop()[0]
            n.error, n.end = True, max([n.end, *(c.end for c in n.children)])
        end_statement()
        # a bracket that closes late stretches the statements around it
        for n in reversed(list(root.walk())):
            if n is not root and n.children:
                n.end = max(n.end, n.children[-1].end)
        return Tree(code, root)

    return parse
