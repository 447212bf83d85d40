"""Python sources as trees, from the interpreter's own syntax tree; gaps are filled with tokens."""

from __future__ import annotations

import ast
import io
import tokenize

from .trees import Node, Tree

#: Node kind, and field names of the children by attribute.
KINDS: dict[str, tuple[str, dict[str, str]]] = {
    "Module": ("module", {}),
    "FunctionDef": ("function_definition", {"args": "parameters", "returns": "return_type"}),
    "AsyncFunctionDef": ("function_definition", {"args": "parameters", "returns": "return_type"}),
    "ClassDef": ("class_definition", {}),
    "Return": ("return_statement", {}),
    "Delete": ("delete_statement", {}),
    "Assign": ("assignment", {"targets": "left", "value": "right"}),
    "AnnAssign": ("assignment", {"target": "left", "annotation": "type", "value": "right"}),
    "AugAssign": ("augmented_assignment", {"target": "left", "value": "right"}),
    "For": ("for_statement", {"target": "left", "iter": "right"}),
    "While": ("while_statement", {"test": "condition"}),
    "If": ("if_statement", {"test": "condition"}),
    "With": ("with_statement", {}),
    "Raise": ("raise_statement", {}),
    "Try": ("try_statement", {}),
    "Assert": ("assert_statement", {}),
    "Import": ("import_statement", {}),
    "ImportFrom": ("import_from_statement", {}),
    "Pass": ("pass_statement", {}),
    "Break": ("break_statement", {}),
    "Continue": ("continue_statement", {}),
    "BoolOp": ("boolean_operator", {}),
    "BinOp": ("binary_operator", {"left": "left", "right": "right"}),
    "UnaryOp": ("unary_operator", {"operand": "argument"}),
    "Lambda": ("lambda", {"args": "parameters", "body": "body"}),
    "IfExp": ("conditional_expression", {}),
    "Dict": ("dictionary", {}),
    "Set": ("set", {}),
    "List": ("list", {}),
    "Tuple": ("tuple", {}),
    "ListComp": ("list_comprehension", {"elt": "body"}),
    "SetComp": ("set_comprehension", {"elt": "body"}),
    "DictComp": ("dictionary_comprehension", {}),
    "GeneratorExp": ("generator_expression", {"elt": "body"}),
    "Await": ("await", {}),
    "Yield": ("yield", {}),
    "Compare": ("comparison_operator", {}),
    "Call": ("call", {"func": "function"}),
    "JoinedStr": ("string", {}),
    "Attribute": ("attribute", {"value": "object"}),
    "Subscript": ("subscript", {"value": "value", "slice": "subscript"}),
    "Name": ("identifier", {}),
    "keyword": ("keyword_argument", {"value": "value"}),
    "arg": ("identifier", {}),
    "alias": ("dotted_name", {}),
    "ExceptHandler": ("except_clause", {}),
    "Starred": ("list_splat", {}),
}


def parse_python(code: str) -> Tree:
    raw = code.encode()
    root = Node("module", 0, len(raw))
    try:
        module = ast.parse(code)
        tokens = list(tokenize.generate_tokens(io.StringIO(code).readline))
    except (SyntaxError, ValueError, tokenize.TokenError):
        root.children.append(Node("ERROR", 0, len(raw), error=True))
        return Tree(code, root)
    lines = [0]
    for text in code.splitlines(keepends=True):
        lines.append(lines[-1] + len(text.encode()))
    text_lines = code.splitlines(keepends=True)

    def span(n: ast.AST) -> tuple[int, int]:
        return lines[n.lineno - 1] + n.col_offset, lines[n.end_lineno - 1] + n.end_col_offset

    def block(kind: str, items: list, field: str | None) -> list[Node]:
        kids = [build(x) for x in items]
        return [Node(kind, kids[0].start, kids[-1].end, True, field, children=kids)] if kids else []

    def build(n: ast.AST, field: str | None = None) -> Node:
        name = type(n).__name__
        start, end = span(n)
        for d in getattr(n, "decorator_list", ()):
            start = min(start, span(d)[0] - 1)
        if isinstance(n, ast.Constant):
            kind = {bool: "true" if n.value else "false", str: "string", bytes: "string", int: "integer", float: "float", complex: "integer", type(None): "none", type(...): "ellipsis"}[type(n.value)]
            return Node(kind, start, end, True, field)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return Node("not_operator", start, end, True, field, children=[build(n.operand, "argument")])
        kind, fields = KINDS.get(name, (name.lower(), {}))
        out = Node(kind, start, end, True, field)
        if isinstance(n, ast.Name | ast.arg) or kind == "string":
            return out
        for key, value in ast.iter_fields(n):
            if key in ("body", "orelse", "finalbody") and isinstance(value, list):
                out.children += block("block", value, {"body": "body" if kind != "if_statement" else "consequence", "orelse": "alternative", "finalbody": "finalizer"}[key])
            elif key == "args" and isinstance(n, ast.Call):
                pass
            elif isinstance(value, ast.arguments):
                got = [build(a) for a in (*value.posonlyargs, *value.args, *([value.vararg] if value.vararg else []), *value.kwonlyargs, *([value.kwarg] if value.kwarg else []))]
                got += [build(d) for d in (*value.defaults, *(d for d in value.kw_defaults if d))]
                got.sort(key=lambda x: x.start)
                if got:
                    out.children.append(Node("parameters", got[0].start, got[-1].end, True, "parameters", children=got))
            elif isinstance(value, ast.AST) and hasattr(value, "lineno"):
                out.children.append(build(value, fields.get(key)))
            elif key == "generators":
                for g in value:
                    kids = [build(g.target, "left"), build(g.iter, "right"), *map(build, g.ifs)]
                    out.children.append(Node("for_in_clause", kids[0].start, kids[-1].end, children=kids))
            elif key == "items" and isinstance(n, ast.With | ast.AsyncWith):
                out.children += [build(x) for i in value for x in (i.context_expr, i.optional_vars) if x is not None]
            elif isinstance(value, list):
                out.children += [build(x, fields.get(key)) for x in value if isinstance(x, ast.AST) and hasattr(x, "lineno") and key not in ("keywords",) or isinstance(x, ast.keyword) and not isinstance(n, ast.Call)]
        if isinstance(n, ast.Dict):
            pairs = [Node("pair", span(k)[0], span(v)[1], children=[build(k, "key"), build(v, "value")]) for k, v in zip(n.keys, n.values, strict=True) if k is not None]
            out.children = [*pairs, *(build(v) for k, v in zip(n.keys, n.values, strict=True) if k is None)]
        if isinstance(n, ast.Call):
            inner = sorted([build(a) for a in n.args] + [build(k) for k in n.keywords], key=lambda x: x.start)
            begin = span(n.func)[1]
            while raw[begin : begin + 1] not in (b"(", b""):
                begin += 1
            out.children.append(Node("argument_list", begin, end, True, "arguments", children=inner))
        if isinstance(n, ast.Attribute):
            out.children.append(Node("identifier", end - len(n.attr.encode()), end, True, "attribute"))
        out.children.sort(key=lambda x: x.start)
        if isinstance(n, ast.Expr | ast.Assign | ast.AnnAssign | ast.AugAssign):
            if isinstance(n, ast.Expr):
                out.kind = "expression_statement"
                return out
            return Node("expression_statement", start, end, True, field, children=[out])
        return out

    root.children = [build(s) for s in module.body]
    for t in tokens:
        if t.type in (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER) or not t.string:
            continue
        row, col = t.start
        s = lines[row - 1] + len(text_lines[row - 1][:col].encode())
        e = s + len(t.string.encode())
        n = root
        while True:
            inner = next((c for c in n.children if c.start <= s and c.end >= e), None)
            if inner is None:
                break
            n = inner
        if (n.start, n.end) == (s, e) and not n.children or n.kind in ("string", "dotted_name") and n is not root:
            continue
        named = t.type == tokenize.COMMENT or t.type == tokenize.NAME and t.string.isidentifier() and n.kind in ("function_definition", "class_definition", "keyword_argument") and t.string not in ("def", "class", "async")
        leaf = Node("comment" if t.type == tokenize.COMMENT else "identifier" if named else t.string, s, e, named, "name" if named and t.type == tokenize.NAME else None)
        if any(c.start < e and c.end > s for c in n.children):
            continue
        i = next((j for j, c in enumerate(n.children) if c.start >= e), len(n.children))
        n.children.insert(i, leaf)
    return Tree(code, root)
