"""A parser for Java: declarations, statements and expressions, with anonymous tokens as leaves.

Node kinds and field names are those that rule packs for Java name.  A statement
or member that cannot be parsed becomes an ERROR node up to the next boundary.
"""

from __future__ import annotations

import re

from .trees import Node, Tree

TOKEN = re.compile(
    r"""(?P<id>[^\W\d]\w*|\$\w*)|(?P<mark>[(){};,\[\]@~?])|(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<text>\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*")|(?P<char>'(?:\\.|[^'\\\n])+')
    |(?P<num>0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDlL]?)
    |(?P<op>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@])|(?P<bad>\S)""",
    re.S | re.X,
)
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
PRIMITIVES = {**dict.fromkeys("byte short int long char".split(), "integral_type"), "float": "floating_point_type", "double": "floating_point_type", "boolean": "boolean_type", "void": "void_type"}
RESERVED = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
BINARY = [("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">=", "instanceof"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%")]
OPERATORS = frozenset(op for level in BINARY for op in level)
ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<= >>= >>>=".split())


class _Fail(Exception):
    pass


class JavaParser:
    def __init__(self, code: str):
        self.toks: list[tuple[str, str, int, int]] = []
        self.comments: list[Node] = []
        wide = not code.isascii()
        toks, more, pos = self.toks, 0, 0  # more: bytes beyond one a character, counted up to pos
        for m in TOKEN.finditer(code):
            kind, (start, end) = m.lastgroup, m.span()
            if wide:
                between, own = code[pos:start], m[0]
                more += 0 if between.isascii() else len(between.encode()) - len(between)
                grown = 0 if own.isascii() else len(own.encode()) - len(own)
                start, end, pos, more = start + more, end + more + grown, end, more + grown
            if kind == "line" or kind == "block":
                self.comments.append(Node(f"{kind}_comment", start, end))
            else:
                toks.append(("op" if kind == "mark" else kind, m[0], start, end))
        self.length = len(code.encode())
        self.i = 0

    # tokens
    def peek(self, k: int = 0) -> str:
        try:
            return self.toks[self.i + k][1]
        except IndexError:
            return ""

    def kind(self, k: int = 0) -> str:
        try:
            return self.toks[self.i + k][0]
        except IndexError:
            return ""

    def leaf(self, kind: str | None = None, field: str | None = None) -> Node:
        if self.i >= len(self.toks):
            raise _Fail
        _, text, s, e = self.toks[self.i]
        self.i += 1
        return Node(kind or text, s, e, kind is not None, field)

    def want(self, text: str, field: str | None = None) -> Node:
        if text == ">" and self.kind() == "op" and self.peek().startswith(">") and len(self.peek()) > 1 and set(self.peek()) == {">"}:
            g, t, s, e = self.toks[self.i]
            self.toks[self.i : self.i + 1] = [(g, ">", s, s + 1), (g, t[1:], s + 1, e)]
        if self.peek() != text or self.kind() in ("text", "char"):
            raise _Fail
        return self.leaf(None, field)

    def identifier(self, kind: str = "identifier", field: str | None = None) -> Node:
        if self.kind() != "id" or self.peek() in RESERVED:
            raise _Fail
        return self.leaf(kind, field)

    @staticmethod
    def make(kind: str, kids: list[Node | None], field: str | None = None) -> Node:
        if None in kids:
            kids = [k for k in kids if k is not None]
        return Node(kind, kids[0].start, kids[-1].end, True, field, children=kids)

    def attempt(self, f, *args):
        at, toks = self.i, list(self.toks) if len(self.toks) < 400 else None
        try:
            return f(*args)
        except _Fail:
            self.i = at
            if toks is not None:
                self.toks = toks
            return None

    # types
    def type_(self, field: str | None = "type") -> Node:
        if self.peek() in PRIMITIVES:
            t = self.leaf(PRIMITIVES[self.peek()])
        else:
            t = self.identifier("type_identifier")
            if self.peek() == "<":
                t = self.make("generic_type", [t, self.type_arguments()])
            while self.peek() == "." and self.kind(1) == "id" and self.peek(1) not in RESERVED:
                t = self.make("scoped_type_identifier", [t, self.leaf(), self.identifier("type_identifier")])
                if self.peek() == "<":
                    t = self.make("generic_type", [t, self.type_arguments()])
        if self.peek() == "[" and self.peek(1) == "]":
            dims = []
            while self.peek() == "[" and self.peek(1) == "]":
                dims += [self.leaf(), self.leaf()]
            t.field = "element"
            t = self.make("array_type", [t, self.make("dimensions", dims, "dimensions")])
        t.field = field
        return t

    def type_arguments(self, field: str | None = None) -> Node:
        kids = [self.want("<")]
        while self.peek()[:1] != ">":
            if self.peek() == "?":
                w = [self.leaf()]
                if self.peek() in ("extends", "super"):
                    w += [self.leaf(), self.type_(None)]
                kids.append(self.make("wildcard", w))
            else:
                kids.append(self.type_(None))
            if self.peek() == ",":
                kids.append(self.leaf())
            elif self.peek()[:1] != ">":
                raise _Fail
        kids.append(self.want(">"))
        return self.make("type_arguments", kids, field)

    # expressions
    def parenthesized(self, field: str | None = None) -> Node:
        return self.make("parenthesized_expression", [self.want("("), self.expression(), self.want(")")], field)

    def arguments(self, field: str | None = "arguments") -> Node:
        kids = [self.want("(")]
        while self.peek() != ")":
            kids.append(self.expression())
            if self.peek() == ",":
                kids.append(self.leaf())
            elif self.peek() != ")":
                raise _Fail
        kids.append(self.leaf())
        return self.make("argument_list", kids, field)

    def expression(self, field: str | None = None) -> Node:
        if self.peek() == "(" or self.peek(1) == "->":
            lam = self.attempt(self.lambda_)
            if lam is not None:
                lam.field = field
                return lam
        left = self.ternary()
        if self.peek() in ASSIGN and self.kind() == "op":
            left.field = "left"
            op = self.leaf(None, "operator")
            return self.make("assignment_expression", [left, op, self.expression("right")], field)
        left.field = field
        return left

    def lambda_(self) -> Node:
        if self.kind() == "id" and self.peek(1) == "->":
            params = self.identifier("identifier", "parameters")
        elif self.peek() == "(":
            j, depth = self.i, 0
            while j < len(self.toks):
                depth += {"(": 1, ")": -1}.get(self.toks[j][1], 0)
                j += 1
                if not depth:
                    break
            if j >= len(self.toks) or self.toks[j][1] != "->":
                raise _Fail
            params = self.attempt(self.inferred) or self.parameters()
        else:
            raise _Fail
        arrow = self.want("->")
        body = self.block("body") if self.peek() == "{" else self.expression("body")
        return self.make("lambda_expression", [params, arrow, body])

    def inferred(self) -> Node:
        kids = [self.want("(")]
        while self.peek() != ")":
            kids.append(self.identifier())
            if self.peek() == ",":
                kids.append(self.leaf())
            elif self.peek() != ")":
                raise _Fail
        if len(kids) == 1:
            raise _Fail
        kids.append(self.leaf())
        return self.make("inferred_parameters", kids, "parameters")

    def ternary(self) -> Node:
        cond = self.binary(0)
        if self.peek() == "?" and self.kind() == "op":
            cond.field = "condition"
            q = self.leaf()
            yes = self.expression("consequence")
            return self.make("ternary_expression", [cond, q, yes, self.want(":"), self.expression("alternative")])
        return cond

    def binary(self, level: int) -> Node:
        left = self.unary()
        for tight in range(len(BINARY) - 1, level - 1, -1):  # the tightest operators first
            if self.peek() not in OPERATORS:
                break
            left = self.chain(left, tight)
        return left

    def chain(self, left: Node, level: int) -> Node:
        """left with the operators of one level that follow it."""
        while self.peek() in BINARY[level] and self.kind() in ("op", "id") or level == 7 and self.peek() == ">" and self.peek(1) == ">" and self.toks[self.i][3] == self.toks[self.i + 1][2]:
            left.field = "left"
            if self.peek() == ">" and level == 7:
                a = self.leaf()
                b = self.leaf()
                c = self.leaf() if self.peek() == ">" and self.toks[self.i][2] == b.end else None
                op = Node(">>>" if c else ">>", a.start, (c or b).end, False)
            else:
                op = self.leaf()
            op.field = "operator"
            if op.kind == "instanceof":
                op.field = None
                final = self.leaf() if self.peek() == "final" else None
                kids = [left, op, final, self.type_("right")]
                if self.kind() == "id" and self.peek() not in RESERVED:
                    kids.append(self.identifier("identifier", "name"))
                left = self.make("instanceof_expression", kids)
            else:
                right = self.binary(level + 1)
                right.field = "right"
                left = self.make("binary_expression", [left, op, right])
        return left

    def unary(self) -> Node:
        t = self.peek()
        if self.kind() == "op" and t in ("!", "~", "+", "-"):
            op = self.leaf(None, "operator")
            x = self.unary()
            x.field = "operand"
            return self.make("unary_expression", [op, x])
        if self.kind() == "op" and t in ("++", "--"):
            return self.make("update_expression", [self.leaf(), self.unary()])
        if t == "(":
            cast = self.attempt(self.cast)
            if cast is not None:
                return cast
        return self.postfix(self.primary())

    def cast(self) -> Node:
        kids = [self.want("("), self.type_()]
        while self.peek() == "&":
            kids += [self.leaf(), self.type_()]
        kids.append(self.want(")"))
        if kids[1].kind not in ("integral_type", "floating_point_type", "boolean_type") and not (self.kind() in ("id", "num", "text", "char") or self.peek() in ("(", "!", "~")) or self.peek() == "instanceof":
            raise _Fail
        lam = self.attempt(self.lambda_)
        value = lam if lam is not None else self.unary()
        value.field = "value"
        return self.make("cast_expression", [*kids, value])

    def primary(self) -> Node:
        k, t = self.kind(), self.peek()
        if k == "num":
            real = "." in t or re.search(r"[fFdD]$", t) and not t.startswith("0x")
            return self.leaf("decimal_floating_point_literal" if real else "hex_integer_literal" if t[:2] in ("0x", "0X") else "decimal_integer_literal")
        if k == "text":
            return self.leaf("string_literal")
        if k == "char":
            return self.leaf("character_literal")
        if t in ("true", "false", "this", "super"):
            return self.leaf(t)
        if t == "null":
            return self.leaf("null_literal")
        if t == "(":
            return self.parenthesized()
        if t == "new":
            return self.new()
        if t == "switch":
            return self.switch()
        if t in PRIMITIVES:
            at = self.type_(None)
            if self.peek() in ("::", "."):
                return at
            raise _Fail
        return self.identifier()

    def new(self) -> Node:
        kids: list[Node | None] = [self.leaf(), self.type_()]
        if self.peek() == "(":
            kids.append(self.arguments())
            if self.peek() == "{":
                kids.append(self.class_body("class_body", None))
            return self.make("object_creation_expression", kids)
        if kids[1].kind == "array_type" and self.peek() == "{":
            return self.make("array_creation_expression", [*kids, self.initializer("value")])
        while self.peek() == "[" and self.peek(1) != "]":
            kids.append(self.make("dimensions_expr", [self.leaf(), self.expression(), self.want("]")], "dimensions"))
        if len(kids) == 2 and self.peek() != "<":
            raise _Fail
        dims = []
        while self.peek() == "[" and self.peek(1) == "]":
            dims += [self.leaf(), self.leaf()]
        if dims:
            kids.append(self.make("dimensions", dims, "dimensions"))
        if self.peek() == "<" and self.peek(1) == ">":
            kids[1] = self.make("generic_type", [kids[1], self.make("type_arguments", [self.leaf(), self.leaf()])], "type")
            kids.append(self.arguments())
            return self.make("object_creation_expression", kids)
        return self.make("array_creation_expression", kids)

    def initializer(self, field: str | None = None) -> Node:
        kids = [self.want("{")]
        while self.peek() != "}":
            kids.append(self.initializer() if self.peek() == "{" else self.expression())
            if self.peek() == ",":
                kids.append(self.leaf())
            elif self.peek() != "}":
                raise _Fail
        kids.append(self.leaf())
        return self.make("array_initializer", kids, field)

    def postfix(self, x: Node) -> Node:
        while True:
            t = self.peek()
            if self.kind() != "op":
                return x
            if t == "(" and x.kind == "identifier":
                x.field = "name"
                x = self.make("method_invocation", [x, self.arguments()])
            elif t == "(" and x.kind in ("this", "super"):
                x = self.make("explicit_constructor_invocation", [x, self.arguments()])
            elif t == ".":
                dot = self.leaf()
                targs = self.type_arguments("type_arguments") if self.peek() == "<" else None
                x.field = "object"
                if self.peek() in ("class", "this", "super", "new"):
                    if self.peek() == "class":
                        x.field = None
                        x = self.make("class_literal", [x, dot, self.leaf()])
                    elif self.peek() == "new":
                        x = self.make("object_creation_expression", [x, dot, self.new()])
                    else:
                        x = self.make("field_access", [x, dot, self.leaf(self.peek(), "field")])
                    continue
                name = self.identifier()
                if self.peek() == "(":
                    name.field = "name"
                    x = self.make("method_invocation", [x, dot, targs, name, self.arguments()])
                else:
                    name.field = "field"
                    x = self.make("field_access", [x, dot, name])
            elif t == "[":
                x.field = "array"
                x = self.make("array_access", [x, self.leaf(), self.expression("index"), self.want("]")])
            elif t in ("++", "--"):
                x = self.make("update_expression", [x, self.leaf()])
            elif t == "::":
                op = self.leaf()
                x = self.make("method_reference", [x, op, self.leaf("new" if self.peek() == "new" else "identifier")])
            else:
                return x

    # statements
    def block(self, field: str | None = None) -> Node:
        kids = [self.want("{"), *self.until("}", self.statement)]
        kids.append(self.want("}"))
        return self.make("block", kids, field)

    def until(self, close: str, item) -> list[Node]:
        """Items up to close; what cannot be parsed becomes an ERROR up to the next boundary."""
        out: list[Node] = []
        while self.i < len(self.toks) and self.peek() != close:
            at = self.i
            node = self.attempt(item)
            if node is None:
                self.i = at
                bad, depth = [], 0
                while self.i < len(self.toks) and not (self.peek() == close and depth == 0):
                    t = self.leaf("identifier" if self.kind() == "id" and self.peek() not in RESERVED else None)
                    bad.append(t)
                    depth += {"{": 1, "}": -1}.get(t.kind, 0)
                    if depth <= 0 and t.kind in (";", "}"):
                        break
                node = self.make("ERROR", bad)
                node.error = True
            out.append(node)
        return out

    def statement(self, field: str | None = None) -> Node:
        n = self.statement_()
        n.field = field
        return n

    def statement_(self) -> Node:
        t = self.peek()
        m = getattr(self, f"s_{t}", None) if self.kind() == "id" else None
        if m is not None:
            return m()
        if t == "{":
            return self.block()
        if t == ";":
            return self.leaf()
        if self.kind() == "id" and self.peek(1) == ":" and t not in RESERVED:
            return self.make("labeled_statement", [self.identifier(), self.leaf(), self.statement()])
        if t in ("class", "interface", "enum") or t in ("abstract", "static") or t == "final" and self.peek(1) == "class" or self.record():
            return self.member()
        local = None if self.kind() == "id" and self.peek(1) == "(" else self.attempt(self.local)  # no declaration begins as a call does
        if local is not None:
            return local
        return self.make("expression_statement", [self.expression(), self.want(";")])

    def local(self) -> Node:
        kids = [self.modifiers(), self.type_(), *self.declarators(), self.want(";")]
        return self.make("local_variable_declaration", kids)

    def declarators(self) -> list[Node]:
        out = []
        while True:
            kids: list[Node | None] = [self.identifier("identifier", "name")]
            if self.peek() == "[" and self.peek(1) == "]":
                kids.append(self.make("dimensions", [self.leaf(), self.leaf()], "dimensions"))
            if self.peek() == "=":
                kids.append(self.leaf())
                kids.append(self.initializer("value") if self.peek() == "{" else self.expression("value"))
            elif self.peek() not in (",", ";"):
                raise _Fail
            out.append(self.make("variable_declarator", kids, "declarator"))
            if self.peek() != ",":
                return out
            out.append(self.leaf())

    def s_if(self) -> Node:
        kids = [self.leaf(), self.parenthesized("condition"), self.statement("consequence")]
        if self.peek() == "else":
            kids += [self.leaf(), self.statement("alternative")]
        return self.make("if_statement", kids)

    def s_while(self) -> Node:
        return self.make("while_statement", [self.leaf(), self.parenthesized("condition"), self.statement("body")])

    def s_do(self) -> Node:
        return self.make("do_statement", [self.leaf(), self.statement("body"), self.want("while"), self.parenthesized("condition"), self.want(";")])

    def s_for(self) -> Node:
        start = self.leaf()
        each = self.attempt(self.for_each, start)
        if each is not None:
            return each
        kids: list[Node | None] = [start, self.want("(")]
        local = self.attempt(self.local) if self.peek() != ";" else None
        if local is not None:
            local.field = "init"
            kids.append(local)
        else:
            while self.peek() != ";":
                kids.append(self.expression("init"))
                if self.peek() == ",":
                    kids.append(self.leaf())
            kids.append(self.want(";"))
        if self.peek() != ";":
            kids.append(self.expression("condition"))
        kids.append(self.want(";"))
        while self.peek() != ")":
            kids.append(self.expression("update"))
            if self.peek() == ",":
                kids.append(self.leaf())
        kids += [self.want(")"), self.statement("body")]
        return self.make("for_statement", kids)

    def for_each(self, start: Node) -> Node:
        kids = [start, self.want("("), self.modifiers(), self.type_(), self.identifier("identifier", "name"), self.want(":"), self.expression("value"), self.want(")"), self.statement("body")]
        return self.make("enhanced_for_statement", kids)

    def s_return(self) -> Node:
        return self.make("return_statement", [self.leaf(), None if self.peek() == ";" else self.expression(), self.want(";")])

    def s_throw(self) -> Node:
        return self.make("throw_statement", [self.leaf(), self.expression(), self.want(";")])

    def s_break(self) -> Node:
        k = self.peek()
        return self.make(f"{k}_statement", [self.leaf(), None if self.peek() == ";" else self.identifier(), self.want(";")])

    s_continue = s_break

    def s_assert(self) -> Node:
        kids = [self.leaf(), self.expression()]
        if self.peek() == ":":
            kids += [self.leaf(), self.expression()]
        return self.make("assert_statement", [*kids, self.want(";")])

    def s_synchronized(self) -> Node:
        return self.make("synchronized_statement", [self.leaf(), self.parenthesized(), self.block("body")])

    def resource(self) -> Node:
        return self.make("resource", [self.modifiers(), self.type_(), self.identifier("identifier", "name"), self.want("="), self.expression("value")])

    def s_try(self) -> Node:
        kids: list[Node | None] = [self.leaf()]
        kind = "try_statement"
        if self.peek() == "(":
            kind = "try_with_resources_statement"
            r = [self.leaf()]
            while self.peek() != ")":
                declared = self.attempt(self.resource)
                r.append(declared if declared is not None else self.make("resource", [self.expression()]))
                if self.peek() == ";":
                    r.append(self.leaf())
            r.append(self.leaf())
            kids.append(self.make("resource_specification", r, "resources"))
        kids.append(self.block("body"))
        while self.peek() == "catch":
            c = [self.leaf(), self.want("(")]
            types = [self.type_(None)]
            while self.peek() == "|":
                types += [self.leaf(), self.type_(None)]
            c.append(self.make("catch_formal_parameter", [self.make("catch_type", types), self.identifier("identifier", "name")]))
            c += [self.want(")"), self.block("body")]
            kids.append(self.make("catch_clause", c))
        if self.peek() == "finally":
            kids.append(self.make("finally_clause", [self.leaf(), self.block()]))
        return self.make(kind, kids)

    def switch(self) -> Node:
        kids = [self.leaf(), self.parenthesized("condition")]
        body: list[Node] = [self.want("{")]
        while self.peek() != "}":
            group: list[Node] = []
            while self.peek() in ("case", "default"):
                label = [self.leaf()]
                while label[0].kind == "case" and self.peek() not in (":", "->"):
                    label.append(self.ternary())
                    if self.peek() == ",":
                        label.append(self.leaf())
                group.append(self.make("switch_label", label))
                group.append(self.leaf())
            if not group:
                raise _Fail
            if group[-1].kind == "->":
                group.append(self.statement())
                body.append(self.make("switch_rule", group))
            else:
                while self.peek() not in ("case", "default", "}"):
                    group.append(self.statement())
                body.append(self.make("switch_block_statement_group", group))
        body.append(self.leaf())
        return self.make("switch_expression", [*kids, self.make("switch_block", body, "body")])

    def s_switch(self) -> Node:
        return self.switch()

    # declarations
    def modifiers(self) -> Node | None:
        kids = []
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                a = [self.leaf(), self.name("name")]
                if self.peek() == "(":
                    a.append(self.annotation_arguments())
                    kids.append(self.make("annotation", a))
                else:
                    kids.append(self.make("marker_annotation", a))
            elif (self.peek(), self.peek(1), self.peek(2)) == ("non", "-", "sealed"):
                a, _, b = self.leaf(), self.leaf(), self.leaf()
                kids.append(Node("non-sealed", a.start, b.end, False))
            elif self.peek() in MODIFIERS and self.peek(1) not in ("->", ":", "("):
                kids.append(self.leaf())
            else:
                return self.make("modifiers", kids) if kids else None

    def annotation_arguments(self) -> Node:
        kids = [self.want("(")]
        while self.peek() != ")":
            if self.kind() == "id" and self.peek(1) == "=":
                kids.append(self.make("element_value_pair", [self.identifier("identifier", "key"), self.leaf(), self.initializer("value") if self.peek() == "{" else self.expression("value")]))
            else:
                kids.append(self.initializer() if self.peek() == "{" else self.expression())
            if self.peek() == ",":
                kids.append(self.leaf())
        kids.append(self.leaf())
        return self.make("annotation_argument_list", kids, "arguments")

    def name(self, field: str | None = None) -> Node:
        n = self.identifier()
        while self.peek() == "." and self.kind(1) == "id":
            n.field = "scope"
            n = self.make("scoped_identifier", [n, self.leaf(), self.identifier("identifier", "name")])
        n.field = field
        return n

    def parameters(self) -> Node:
        kids = [self.want("(")]
        while self.peek() != ")":
            mods, type_ = self.modifiers(), self.type_()
            if self.peek() == "...":
                kids.append(self.make("spread_parameter", [mods, type_, self.leaf(), self.make("variable_declarator", [self.identifier("identifier", "name")])]))
            else:
                kids.append(self.make("formal_parameter", [mods, type_, self.identifier("identifier", "name")]))
            if self.peek() == ",":
                kids.append(self.leaf())
            elif self.peek() != ")":
                raise _Fail
        kids.append(self.leaf())
        return self.make("formal_parameters", kids, "parameters")

    def class_body(self, kind: str, field: str | None = "body") -> Node:
        kids = [self.want("{"), *self.until("}", self.member)]
        kids.append(self.want("}"))
        return self.make(kind, kids, field)

    def type_list(self) -> list[Node]:
        kids = [self.type_(None)]
        while self.peek() == ",":
            kids += [self.leaf(), self.type_(None)]
        return [self.make("type_list", kids)]

    def type_parameters(self) -> Node | None:
        if self.peek() != "<":
            return None
        kids = [self.leaf()]
        while self.peek()[:1] != ">":
            p = [self.identifier("type_identifier")]
            if self.peek() == "extends":
                b = [self.leaf(), self.type_(None)]
                while self.peek() == "&":
                    b += [self.leaf(), self.type_(None)]
                p.append(self.make("type_bound", b))
            kids.append(self.make("type_parameter", p))
            if self.peek() == ",":
                kids.append(self.leaf())
        kids.append(self.want(">"))
        return self.make("type_parameters", kids, "type_parameters")

    def record(self) -> bool:
        """A record follows; since records exist no type has this name."""
        return self.peek() == "record" and self.kind(1) == "id" and self.peek(2) in ("(", "<")

    def member(self) -> Node:
        if self.peek() == ";":
            return self.leaf()
        if self.peek() == "{":
            return self.block()
        if self.peek() == "static" and self.peek(1) == "{":
            return self.make("static_initializer", [self.leaf(), self.block()])
        mods = self.modifiers()
        t = self.peek()
        if t in ("class", "interface", "enum") or t == "@":
            at = self.leaf() if t == "@" else None
            kids: list[Node | None] = [mods, at, self.leaf(), self.identifier("identifier", "name"), self.type_parameters()]
            if self.peek() == "extends":
                k = self.leaf()
                kids.append(self.make("superclass", [k, self.type_(None)], "superclass") if t == "class" else self.make("extends_interfaces", [k, *self.type_list()]))
            if self.peek() == "implements":
                kids.append(self.make("super_interfaces", [self.leaf(), *self.type_list()], "interfaces"))
            if self.peek() == "permits":
                kids.append(self.make("permits", [self.leaf(), *self.type_list()], "permits"))
            if t == "enum":
                return self.make("enum_declaration", [*kids, self.enum_body()])
            kind = "annotation_type" if at else t
            return self.make(f"{kind}_declaration", [*kids, self.class_body(f"{kind}_body")])
        if self.record():
            kids = [mods, self.leaf(), self.identifier("identifier", "name"), self.type_parameters(), self.parameters()]
            if self.peek() == "implements":
                kids.append(self.make("super_interfaces", [self.leaf(), *self.type_list()], "interfaces"))
            return self.make("record_declaration", [*kids, self.class_body("class_body")])
        if self.kind() == "id" and self.peek(1) == "{" and t not in RESERVED:
            return self.make("compact_constructor_declaration", [mods, self.identifier("identifier", "name"), self.block("body")])
        params = self.type_parameters()
        if self.kind() == "id" and self.peek(1) == "(" and t not in RESERVED:
            kids = [mods, params, self.identifier("identifier", "name"), self.parameters(), self.throws()]
            body = self.block("body")
            body.kind = "constructor_body"
            return self.make("constructor_declaration", [*kids, body])
        type_ = self.type_()
        if self.peek(1) == "(":
            kids = [mods, params, type_, self.identifier("identifier", "name"), self.parameters(), self.throws()]
            if self.peek() == "default":
                kids += [self.leaf(), self.expression("value")]
            return self.make("method_declaration", [*kids, self.leaf() if self.peek() == ";" else self.block("body")])
        return self.make("field_declaration", [mods, type_, *self.declarators(), self.want(";")])

    def throws(self) -> Node | None:
        if self.peek() != "throws":
            return None
        kids = [self.leaf(), self.type_(None)]
        while self.peek() == ",":
            kids += [self.leaf(), self.type_(None)]
        return self.make("throws", kids)

    def enum_body(self) -> Node:
        kids = [self.want("{")]
        while self.peek() not in (";", "}"):
            c: list[Node | None] = [self.modifiers(), self.identifier("identifier", "name")]
            if self.peek() == "(":
                c.append(self.arguments())
            if self.peek() == "{":
                c.append(self.class_body("class_body"))
            kids.append(self.make("enum_constant", c))
            if self.peek() == ",":
                kids.append(self.leaf())
            elif self.peek() not in (";", "}"):
                raise _Fail
        if self.peek() == ";":
            kids.append(self.make("enum_body_declarations", [self.leaf(), *self.until("}", self.member)]))
        kids.append(self.want("}"))
        return self.make("enum_body", kids, "body")

    def top(self) -> Node:
        if self.peek() == "package" or self.peek() == "import":
            kind = f"{self.peek()}_declaration"
            kids: list[Node | None] = [self.leaf()]
            if self.peek() == "static":
                kids.append(self.leaf())
            kids.append(self.name())
            if self.peek() == ".":
                kids += [self.leaf(), self.make("asterisk", [self.want("*")])]
            return self.make(kind, [*kids, self.want(";")])
        return self.attempt(self.member) or self.statement()


def attach(root: Node, comments: list[Node]) -> None:
    """Puts each comment under the deepest node around it, in order."""
    for c in comments:
        n = root
        while True:
            inner = next((k for k in n.children if k.start <= c.start and k.end >= c.end and k.children), None)
            if inner is None:
                break
            n = inner
        i = next((j for j, k in enumerate(n.children) if k.start >= c.end), len(n.children))
        n.children.insert(i, c)


def parse_java(code: str) -> Tree:
    p = JavaParser(code)
    items: list[Node] = []
    while p.i < len(p.toks):
        got = p.until("", p.top)
        if not got:
            break
        items += got
    root = Node("program", 0, p.length, True, children=items)
    attach(root, p.comments)
    return Tree(code, root)
