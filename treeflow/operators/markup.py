"""Parsers for HTML, JSON and S-expressions into the common tree form."""

from __future__ import annotations

import re

from .trees import Node, Tree

TAG = re.compile(rb"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<![^>]*>|[^<]+|<", re.S)
VOID = frozenset(b"area base br col embed hr img input link meta param source track wbr".split())
RAW = (b"script", b"style")


def parse_html(code: str) -> Tree:
    """Elements by tag name, with text and comment leaves; a paragraph ends where the next block begins."""
    raw = code.encode()
    root = Node("document", 0, len(raw))
    stack, pos = [root], 0
    blocks = frozenset(b"p div ul ol table article section nav footer header aside form h1 h2 h3 h4 h5 h6 blockquote pre".split())

    def close(k: int, at: int) -> None:
        for n in stack[k:]:
            n.end = at
        del stack[k:]

    while pos < len(raw):
        m = TAG.match(raw, pos)
        start, pos = m.start(), m.end()
        name = (m[2] or b"").lower()
        if not name:
            if m[0].startswith(b"<!--"):
                stack[-1].children.append(Node("comment", start, pos))
            elif not m[0].startswith(b"<!") and m[0].strip():
                stack[-1].children.append(Node("text", start, pos))
        elif m[1]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].kind.encode() == name), None)
            if k is not None:
                close(k, pos)
        else:
            if name in blocks:
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].kind.encode() in blocks | {b"li", b"td"}), None)
                if k is not None and stack[k].kind == "p":
                    close(k, start)
            n = Node(name.decode("utf-8", "replace"), start, pos)
            stack[-1].children.append(n)
            if name in RAW:
                e = re.compile(rb"</" + name + rb"[^>]*>", re.I).search(raw, pos)
                pos = n.end = e.end() if e else len(raw)
            elif name not in VOID and not m[3].endswith(b"/"):
                stack.append(n)
    close(1, len(raw))
    return Tree(code, root)


JSON_TOKEN = re.compile(r'\s*(?:([{}\[\]:,])|("(?:\\.|[^"\\])*")|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null)|(\S))', re.S)


def parse_json(code: str) -> Tree:
    """document > object / array / pair(key, value) / string / number / true / false / null."""
    toks, pos, at = [], 0, 0
    for m in JSON_TOKEN.finditer(code):
        k = m.lastindex
        at += len(code[pos : m.start(k)].encode())
        size = len(m[k].encode())
        toks.append((k, m[k], at, at + size))
        at, pos = at + size, m.end(k)
    i = 0

    def leaf(kind: str, named: bool = True) -> Node:
        nonlocal i
        _, _, s, e = toks[i]
        i += 1
        return Node(kind, s, e, named, error=kind == "ERROR")

    def value() -> Node:
        k, t, _, _ = toks[i]
        if k == 1 and t in "{[":
            close = "}" if t == "{" else "]"
            kids = [leaf(t, False)]
            while i < len(toks) and toks[i][1] != close:
                if toks[i][1] == ",":
                    kids.append(leaf(",", False))
                elif t == "{" and toks[i][0] == 2 and i + 2 < len(toks) and toks[i + 1][1] == ":":
                    key, colon = leaf("string"), leaf(":", False)
                    v = value()
                    key.field, v.field = "key", "value"
                    kids.append(Node("pair", key.start, v.end, children=[key, colon, v]))
                else:
                    kids.append(value() if toks[i][1] not in (":", "}", "]") else leaf("ERROR"))
            if i < len(toks):
                kids.append(leaf(close, False))
            return Node("object" if t == "{" else "array", kids[0].start, kids[-1].end, children=kids)
        return leaf({2: "string", 3: "number", 4: t}.get(k, "ERROR"))

    items = []
    while i < len(toks):
        items.append(value())
    return Tree(code, Node("document", 0, len(code.encode()), children=items))


SEXP_TOKEN = re.compile(r'(;[^\n]*)|([()\[\]])|("(?:\\.|[^"\\])*")|(@[\w.-]+)|(#[\w?!.-]+)|([\w-]+:)|([*+?.])|(![\w-]+)|([\w-]+)|(\S)')


def parse_scm(code: str) -> Tree:
    """Tree queries as a tree: program > named_node / list / predicate / capture / string / identifier ..."""
    names = {1: "comment", 3: "string", 4: "capture", 5: "predicate_type", 6: "field_name", 7: "quantifier", 8: "negated_field", 9: "identifier", 10: "ERROR"}
    root = Node("program", 0, len(code.encode()))
    stack, pos, at = [root], 0, 0
    for m in SEXP_TOKEN.finditer(code):
        at += len(code[pos : m.start()].encode())
        size = len(m[0].encode())
        k = m.lastindex
        if k == 2 and m[0] in "([":
            n = Node("named_node" if m[0] == "(" else "list", at, at + size, children=[Node(m[0], at, at + size, False)])
            stack[-1].children.append(n)
            stack.append(n)
        elif k == 2:
            n = Node(m[0], at, at + size, False)
            if len(stack) > 1:
                stack[-1].children.append(n)
                stack.pop().end = at + size
            else:
                n.error = True
                root.children.append(n)
        else:
            if k == 5 and len(stack[-1].children) == 1:
                stack[-1].kind = "predicate"
            stack[-1].children.append(Node(names[k], at, at + size, error=k == 10))
        at, pos = at + size, m.end()
    for n in stack[1:]:
        n.end, n.error = at, True
    return Tree(code, root)


def parse_lines(code: str) -> Tree:
    """Plain text: document > line; also the form of .strings tables, key and value by '='."""
    raw, at, kids = code.encode(), 0, []
    for line in raw.split(b"\n"):
        if line.strip():
            kids.append(Node("line", at, at + len(line)))
        at += len(line) + 1
    return Tree(code, Node("document", 0, len(raw), children=kids))
