"""A parser for Go, sharing the expression and recovery machinery of the Java parser."""

from __future__ import annotations

import re

from .java import JavaParser, _Fail, attach
from .trees import Node, Tree

TOKEN = re.compile(
    r"""(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<raw>`[^`]*`)|(?P<text>"(?:\\.|[^"\\\n])*")|(?P<char>'(?:\\.|[^'\\\n])+')|(?P<nl>\n)
    |(?P<num>0[xX][0-9a-fA-F_]+|0[bBoO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)|(?P<id>[^\W\d]\w*)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^!~<>=:;,.(){}\[\]])|(?P<bad>\S)""",
    re.S | re.X,
)
WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BINARY = [("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">="), ("+", "-", "|", "^"), ("*", "/", "%", "<<", ">>", "&", "&^")]
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())


class GoParser(JavaParser):
    def __init__(self, code: str):
        at = pos = 0
        self.toks, self.comments = [], []
        last: tuple[str, str] = ("", "")

        def line_end(p: int) -> None:
            nonlocal last
            if last[0] in ("id", "num", "text", "raw", "char") and (last[1] not in WORDS or last[1] in ("break", "continue", "fallthrough", "return")) or last[1] in ("++", "--", ")", "]", "}"):
                self.toks.append(("auto", "\n", p, p))
                last = ("auto", "\n")

        for m in TOKEN.finditer(code):
            at += len(code[pos : m.start()].encode())
            size, pos, kind = len(m[0].encode()), m.end(), m.lastgroup
            if kind in ("line", "block"):
                self.comments.append(Node("comment", at, at + size))
                if kind == "block" and "\n" in m[0]:
                    line_end(at)
            elif kind == "nl":
                line_end(at)
            else:
                self.toks.append((kind, m[0], at, at + size))
                last = (kind, m[0])
            at += size
        line_end(at)
        self.length, self.i, self.no_composite = len(code.encode()), 0, 0

    def end(self) -> list[Node]:
        """What ends a statement: a semicolon leaf, a line end, or a closing bracket ahead."""
        if self.peek() == "\n":
            self.i += 1
            return []
        if self.peek() == ";":
            return [self.leaf()]
        if self.peek() in ("}", ")", "") or self.peek() in ("case", "default"):
            return []
        raise _Fail

    def identifier(self, kind: str = "identifier", field: str | None = None) -> Node:
        if self.kind() != "id" or self.peek() in WORDS:
            raise _Fail
        return self.leaf(kind, field)

    # types
    def type_(self, field: str | None = "type") -> Node:
        t = self.peek()
        if t == "*":
            n = self.make("pointer_type", [self.leaf(), self.type_(None)])
        elif t == "[":
            kids = [self.leaf()]
            if self.peek() == "]":
                n = self.make("slice_type", [*kids, self.leaf(), self.type_("element")])
            else:
                kids.append(self.leaf() if self.peek() == "..." else self.expression("length"))
                n = self.make("array_type", [*kids, self.want("]"), self.type_("element")])
        elif t == "map":
            n = self.make("map_type", [self.leaf(), self.want("["), self.type_("key"), self.want("]"), self.type_("value")])
        elif t in ("chan", "<-"):
            kids = [self.leaf()]
            while self.peek() in ("chan", "<-"):
                kids.append(self.leaf())
            n = self.make("channel_type", [*kids, self.type_("value")])
        elif t == "func":
            n = self.make("function_type", [self.leaf(), self.parameters(), self.result()])
        elif t in ("struct", "interface"):
            kids = [self.leaf(), self.want("{")]
            depth = 0
            while not (self.peek() == "}" and depth == 0):
                if self.peek() == "\n":
                    self.i += 1
                    continue
                x = self.leaf("identifier" if self.kind() == "id" and self.peek() not in WORDS else None)
                depth += {"{": 1, "}": -1, "(": 1, ")": -1}.get(x.kind, 0)
                kids.append(x)
            kids.append(self.leaf())
            n = self.make(f"{t}_type", kids)
        elif t == "(":
            n = self.make("parenthesized_type", [self.leaf(), self.type_(None), self.want(")")])
        else:
            n = self.identifier("type_identifier")
            if self.peek() == ".":
                n.kind, n.field = "package_identifier", "package"
                n = self.make("qualified_type", [n, self.leaf(), self.identifier("type_identifier", "name")])
            if self.peek() == "[" and self.peek(1) != "]":
                args = self.attempt(self.type_arguments)
                if args is not None:
                    n = self.make("generic_type", [n, args])
        n.field = field
        return n

    def type_arguments(self, field: str | None = None) -> Node:
        kids = [self.want("["), self.type_(None)]
        while self.peek() == ",":
            kids += [self.leaf(), self.type_(None)]
        return self.make("type_arguments", [*kids, self.want("]")], field)

    def parameters(self, field: str = "parameters") -> Node:
        kids = [self.want("(")]
        while self.peek() != ")":
            if self.peek() == "\n":
                self.i += 1
                continue
            named = self.attempt(self.named_parameter)
            kids.append(named if named is not None else self.make("parameter_declaration", [self.leaf() if self.peek() == "..." else None, self.type_()]))
            if self.peek() == ",":
                kids.append(self.leaf())
        kids.append(self.leaf())
        return self.make("parameter_list", kids, field)

    def named_parameter(self) -> Node:
        kids = [self.identifier("identifier", "name")]
        while self.peek() == ",":
            kids += [self.leaf(), self.identifier("identifier", "name")]
        dots = self.leaf() if self.peek() == "..." else None
        if self.peek() in (",", ")", "."):
            raise _Fail
        return self.make("variadic_parameter_declaration" if dots else "parameter_declaration", [*kids, dots, self.type_()])

    def result(self) -> Node | None:
        if self.peek() == "(":
            return self.parameters("result")
        if self.peek() in ("{", "\n", ";", ")", ",", "}", "=", ":=", "]", "") or self.kind() in ("text", "raw"):
            return None
        return self.type_("result")

    # expressions
    def expression(self, field: str | None = None) -> Node:
        x = self.binary(0)
        x.field = field
        return x

    def binary(self, level: int) -> Node:
        if level == len(BINARY):
            return self.unary()
        left = self.binary(level + 1)
        while self.kind() == "op" and self.peek() in BINARY[level]:
            left.field = "left"
            op = self.leaf(None, "operator")
            right = self.binary(level + 1)
            right.field = "right"
            left = self.make("binary_expression", [left, op, right])
        return left

    def unary(self) -> Node:
        if self.kind() == "op" and self.peek() in ("!", "-", "+", "^", "*", "&", "<-"):
            op = self.leaf(None, "operator")
            x = self.unary()
            x.field = "operand"
            return self.make("unary_expression", [op, x])
        return self.postfix(self.primary())

    def primary(self) -> Node:
        k, t = self.kind(), self.peek()
        if k == "num":
            return self.leaf("float_literal" if "." in t or "e" in t.lower() and not t.startswith("0x") else "int_literal")
        if k == "text":
            return self.leaf("interpreted_string_literal")
        if k == "raw":
            return self.leaf("raw_string_literal")
        if k == "char":
            return self.leaf("rune_literal")
        if t in ("true", "false", "nil", "iota"):
            return self.leaf(t)
        if t == "(":
            held, self.no_composite = self.no_composite, 0
            n = self.make("parenthesized_expression", [self.leaf(), self.expression(), self.want(")")])
            self.no_composite = held
            return n
        if t == "func":
            held, self.no_composite = self.no_composite, 0
            n = self.make("func_literal", [self.leaf(), self.parameters(), self.result(), self.block("body")])
            self.no_composite = held
            return n
        if t in ("[", "map", "struct", "chan", "interface"):
            at = self.type_()
            if self.peek() == "{":
                return self.make("composite_literal", [at, self.literal_value()])
            return at
        return self.identifier()

    def literal_value(self) -> Node:
        held, self.no_composite = self.no_composite, 0
        kids = [self.want("{")]
        while self.peek() != "}":
            if self.peek() == "\n":
                self.i += 1
                continue
            v = self.literal_value() if self.peek() == "{" else self.expression()
            if self.peek() == ":":
                v = self.make("keyed_element", [v, self.leaf(), self.literal_value() if self.peek() == "{" else self.expression()])
            kids.append(v)
            if self.peek() == ",":
                kids.append(self.leaf())
            elif self.peek() not in ("}", "\n"):
                raise _Fail
        kids.append(self.leaf())
        self.no_composite = held
        return self.make("literal_value", kids, "body")

    def arguments(self, field: str | None = "arguments") -> Node:
        held, self.no_composite = self.no_composite, 0
        kids = [self.want("(")]
        while self.peek() != ")":
            if self.peek() == "\n":
                self.i += 1
                continue
            x = self.attempt(self.expression)
            kids.append(x if x is not None else self.type_(None))
            if self.peek() == "...":
                kids.append(self.leaf())
            if self.peek() == ",":
                kids.append(self.leaf())
            elif self.peek() not in (")", "\n"):
                raise _Fail
        kids.append(self.leaf())
        self.no_composite = held
        return self.make("argument_list", kids, field)

    def postfix(self, x: Node) -> Node:
        while True:
            t = self.peek()
            if self.kind() != "op":
                return x
            if t == "(":
                x.field = "function"
                x = self.make("call_expression", [x, self.arguments()])
            elif t == ".":
                dot = self.leaf()
                x.field = "operand"
                if self.peek() == "(":
                    inner = [self.leaf(), self.leaf() if self.peek() == "type" else self.type_(), self.want(")")]
                    x = self.make("type_assertion_expression", [x, dot, *inner])
                else:
                    x = self.make("selector_expression", [x, dot, self.identifier("field_identifier", "field")])
            elif t == "[":
                x.field = "operand"
                kids = [x, self.leaf()]
                while self.peek() != "]":
                    kids.append(self.leaf() if self.peek() in (":", ",") else self.expression("index"))
                x = self.make("slice_expression" if any(k.kind == ":" for k in kids) else "index_expression", [*kids, self.leaf()])
            elif t == "{" and not self.no_composite and x.kind in ("identifier", "selector_expression"):
                at, toks = self.i, self.toks
                try:
                    body = self.literal_value()
                except _Fail:
                    self.i, self.toks = at, toks
                    return x
                x.field = "type"
                if x.kind == "identifier":
                    x.kind = "type_identifier"
                x = self.make("composite_literal", [x, body])
            else:
                return x

    # statements
    def block(self, field: str | None = None) -> Node:
        kids = [self.want("{"), *self.until("}", self.line)]
        kids.append(self.want("}"))
        return self.make("block", kids, field)

    def line(self) -> Node:
        while self.peek() == "\n":
            self.i += 1
        if self.peek() == "}":
            raise _Fail
        n = self.statement()
        tail = self.end()
        if tail:
            n.children = n.children or []
        return n

    def until(self, close: str, item) -> list[Node]:
        out = []
        while True:
            while self.peek() == "\n":
                self.i += 1
            if self.i >= len(self.toks) or self.peek() == close:
                return out
            at = self.i
            node = self.attempt(item)
            if node is None:
                self.i = at
                bad, depth = [], 0
                while self.i < len(self.toks) and not (self.peek() == close and depth == 0):
                    if self.peek() == "\n":
                        self.i += 1
                        if bad and depth <= 0:
                            break
                        continue
                    t = self.leaf("identifier" if self.kind() == "id" and self.peek() not in WORDS else None)
                    bad.append(t)
                    depth += {"{": 1, "}": -1}.get(t.kind, 0)
                node = self.make("ERROR", bad)
                node.error = True
            out.append(node)

    def expressions(self, field: str) -> Node:
        kids = [self.expression()]
        while self.peek() == ",":
            kids += [self.leaf(), self.expression()]
        return self.make("expression_list", kids, field)

    def simple(self) -> Node:
        left = self.expressions("left")
        t = self.peek()
        if self.kind() == "op" and t == ":=":
            op = self.leaf()
            if self.peek() == "range":
                return self.make("range_clause", [left, op, self.leaf(), self.expression("right")])
            return self.make("short_var_declaration", [left, op, self.expressions("right")])
        if self.kind() == "op" and t in ASSIGN:
            op = self.leaf(None, "operator")
            if self.peek() == "range":
                return self.make("range_clause", [left, op, self.leaf(), self.expression("right")])
            return self.make("assignment_statement", [left, op, self.expressions("right")])
        if t in ("++", "--"):
            return self.make("inc_statement" if t == "++" else "dec_statement", [*left.children, self.leaf()])
        if t == "<-":
            return self.make("send_statement", [*left.children, self.leaf(), self.expression("value")])
        if len(left.children) > 1:
            raise _Fail
        x = left.children[0]
        x.field = None
        if x.kind != "identifier" or self.peek() != ":":
            return x
        return self.make("labeled_statement", [x, self.leaf(), None if self.peek() in ("}", "\n", ";") else self.statement_()])

    def statement_(self) -> Node:
        t = self.peek()
        if t == "{":
            return self.block()
        if t in ("var", "const"):
            return self.declaration()
        if t == "type":
            return self.make("type_declaration", [self.leaf(), self.make("type_spec", [self.identifier("type_identifier", "name"), self.type_parameters_() if self.generic() else None, self.leaf() if self.peek() == "=" else None, self.type_()])])
        if t == "return":
            r = self.leaf()
            return self.make("return_statement", [r, None if self.peek() in ("\n", ";", "}") else self.expressions("result")])
        if t in ("break", "continue", "goto"):
            k = self.leaf()
            return self.make(f"{t}_statement", [k, self.identifier("label_name") if self.kind() == "id" and self.peek() not in WORDS else None])
        if t == "fallthrough":
            return self.make("fallthrough_statement", [self.leaf()])
        if t in ("go", "defer"):
            return self.make(f"{t}_statement", [self.leaf(), self.expression()])
        if t == "if":
            return self.if_()
        if t == "for":
            return self.for_()
        if t in ("switch", "select"):
            return self.switch_()
        x = self.simple()
        return x

    def header(self, parts: list[Node | None], names: tuple[str, str]) -> None:
        """[simple ;] condition before a block."""
        self.no_composite += 1
        try:
            if self.peek() == ";":
                parts.append(self.leaf())
            if self.peek() != "{":
                first = self.simple()
                if self.peek() == ";":
                    first.field = names[0]
                    parts += [first, self.leaf()]
                    if self.peek() != "{":
                        parts.append(self.expression(names[1]))
                else:
                    first.field = names[1]
                    parts.append(first)
        finally:
            self.no_composite -= 1

    def if_(self) -> Node:
        kids: list[Node | None] = [self.leaf()]
        self.header(kids, ("initializer", "condition"))
        kids.append(self.block("consequence"))
        if self.peek() == "else":
            kids.append(self.leaf())
            other = self.if_() if self.peek() == "if" else self.block()
            other.field = "alternative"
            kids.append(other)
        return self.make("if_statement", kids)

    def for_(self) -> Node:
        kids: list[Node | None] = [self.leaf()]
        if self.peek() != "{":
            self.no_composite += 1
            if self.peek() == "range":
                kids.append(self.make("range_clause", [self.leaf(), self.expression("right")]))
            else:
                clause: list[Node] = [] if self.peek() == ";" else [self.simple()]
                if self.peek() == ";":
                    clause.append(self.leaf())
                    if self.peek() != ";":
                        clause.append(self.expression("condition"))
                    clause.append(self.want(";"))
                    if self.peek() != "{":
                        clause.append(self.simple())
                    kids.append(self.make("for_clause", clause))
                else:
                    kids += clause
            self.no_composite -= 1
        kids.append(self.block("body"))
        return self.make("for_statement", kids)

    def switch_(self) -> Node:
        t = self.peek()
        kids: list[Node | None] = [self.leaf()]
        self.header(kids, ("initializer", "value"))
        kids.append(self.want("{"))
        while self.peek() != "}":
            if self.peek() == "\n":
                self.i += 1
                continue
            case: list[Node] = [self.leaf()]
            kind = "default_case"
            if case[0].kind == "case":
                kind = "communication_case" if t == "select" else "expression_case"
                got = self.attempt(self.simple) if t == "select" else self.attempt(self.expressions, "value")
                case.append(got if got is not None else self.type_(None))
                while self.peek() == ",":
                    case += [self.leaf(), self.type_(None)]
            elif case[0].kind != "default":
                raise _Fail
            case.append(self.want(":"))
            while self.peek() not in ("case", "default", "}"):
                if self.peek() == "\n":
                    self.i += 1
                    continue
                case.append(self.line())
            kids.append(self.make(kind, case))
        kids.append(self.leaf())
        return self.make("select_statement" if t == "select" else "expression_switch_statement", kids)

    def declaration(self) -> Node:
        t = self.peek()
        kids: list[Node] = [self.leaf()]

        def spec() -> Node:
            parts: list[Node | None] = [self.identifier("identifier", "name")]
            while self.peek() == ",":
                parts += [self.leaf(), self.identifier("identifier", "name")]
            if self.peek() not in ("=", "\n", ";", ")"):
                parts.append(self.type_())
            if self.peek() == "=":
                parts += [self.leaf(), self.expressions("value")]
            return self.make(f"{t}_spec", parts)

        if self.peek() == "(":
            kids.append(self.leaf())
            while self.peek() != ")":
                if self.peek() == "\n":
                    self.i += 1
                    continue
                kids.append(spec())
                kids += self.end()
            kids.append(self.leaf())
        else:
            kids.append(spec())
        return self.make(f"{t}_declaration", kids)

    def top(self) -> Node:
        t = self.peek()
        if t == "package":
            n = self.make("package_clause", [self.leaf(), self.identifier("package_identifier")])
        elif t == "import":
            kids: list[Node] = [self.leaf()]

            def spec() -> Node:
                name = self.leaf("package_identifier", "name") if self.kind() == "id" or self.peek() in (".", "_") else None
                if self.kind() not in ("text", "raw"):
                    raise _Fail
                return self.make("import_spec", [name, self.leaf("interpreted_string_literal", "path")])

            if self.peek() == "(":
                specs: list[Node] = [self.leaf()]
                while self.peek() != ")":
                    if self.peek() in ("\n", ";"):
                        self.i += 1
                        continue
                    specs.append(spec())
                kids.append(self.make("import_spec_list", [*specs, self.leaf()]))
            else:
                kids.append(spec())
            n = self.make("import_declaration", kids)
        elif t == "func":
            f = self.leaf()
            receiver = self.parameters("receiver") if self.peek() == "(" else None
            name = self.identifier("field_identifier" if receiver else "identifier", "name")
            generic = self.type_parameters_() if self.peek() == "[" else None
            kids2 = [f, receiver, name, generic, self.parameters(), self.result()]
            n = self.make("method_declaration" if receiver else "function_declaration", [*kids2, self.block("body") if self.peek() == "{" else None])
        else:
            n = self.statement_()
        self.end()
        return n

    def generic(self) -> bool:
        """A list of type parameters follows, not the length of an array."""
        return self.peek() == "[" and self.kind(1) == "id" and (self.kind(2) == "id" or self.peek(2) in (",", "~"))

    def type_parameters_(self) -> Node:
        kids = [self.leaf()]
        depth = 0
        while self.peek() != "]" or depth:
            depth += {"[": 1, "]": -1}.get(self.peek(), 0)
            kids.append(self.leaf("identifier" if self.kind() == "id" else None))
        return self.make("type_parameter_list", [*kids, self.leaf()], "type_parameters")


def parse_go(code: str) -> Tree:
    p = GoParser(code)
    items: list[Node] = []
    while p.i < len(p.toks):
        got = p.until("", p.top)
        if not got:
            break
        items += got
    root = Node("source_file", 0, p.length, children=items)
    attach(root, p.comments)
    return Tree(code, root)
