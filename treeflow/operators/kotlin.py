"""A parser for Kotlin: declarations, statements and expressions, newline aware."""

from __future__ import annotations

import re

from .java import JavaParser, _Fail, attach
from .trees import Node, Tree

TOKEN = re.compile(
    r"""(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<text>\"\"\".*?\"\"\"|"(?:\\.|\$\{[^}\n]*\}|[^"\\\n])*")|(?P<char>'(?:\\.|[^'\\\n])+')
    |(?P<num>0[xX][0-9a-fA-F_]+[uUL]*|0[bB][01_]+[uUL]*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[uUfFL]*)|(?P<id>[^\W\d]\w*|`[^`\n]+`)
    |(?P<op>===|!==|\.\.<|\.\.|\?\.|\?:|!!|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|[-+*/%&|^!<>=?:;,.(){}\[\]@#])|(?P<bad>\S)""",
    re.S | re.X,
)
HARD = frozenset("as break class continue do else false for fun if in interface is null object package return super this throw true try typealias val var when while".split())
MODIFIERS = frozenset("public private protected internal open abstract final sealed data inner enum annotation companion override lateinit const vararg noinline crossinline tailrec operator infix inline external suspend expect actual reified".split())
LEVELS = [("disjunction_expression", ("||",)), ("conjunction_expression", ("&&",)), ("equality_expression", ("==", "!=", "===", "!==")), ("comparison_expression", ("<", ">", "<=", ">=")), ("check_expression", ("in", "!in", "is", "!is")), ("elvis_expression", ("?:",)), ("infix_expression", ()), ("range_expression", ("..", "..<")), ("additive_expression", ("+", "-")), ("multiplicative_expression", ("*", "/", "%")), ("as_expression", ("as",))]


class KotlinParser(JavaParser):
    def __init__(self, code: str):
        at = pos = 0
        self.toks, self.comments, self.fresh = [], [], set()
        for m in TOKEN.finditer(code):
            between = code[pos : m.start()]
            at += len(between.encode())
            size, pos, kind = len(m[0].encode()), m.end(), m.lastgroup
            if "\n" in between:
                self.fresh.add(at)
            if kind in ("line", "block"):
                self.comments.append(Node(f"{'line' if kind == 'line' else 'multiline'}_comment", at, at + size))
                if kind == "block" and "\n" in m[0] or between.count("\n"):
                    self.fresh.add(at + size)
            else:
                self.toks.append((kind, m[0], at, at + size))
            at += size
        # a comment between keeps the line break before the next token
        ends = {c.end for c in self.comments} & self.fresh
        starts = [t[2] for t in self.toks]
        for e in ends:
            nxt = next((s for s in starts if s >= e), None)
            if nxt is not None:
                self.fresh.add(nxt)
        self.length, self.i, self.no_lambda = len(code.encode()), 0, 0

    def new_line(self) -> bool:
        return self.i < len(self.toks) and self.toks[self.i][2] in self.fresh

    def identifier(self, kind: str = "simple_identifier", field: str | None = None) -> Node:
        if self.kind() != "id" or self.peek() in HARD:
            raise _Fail
        return self.leaf(kind, field)

    def end(self) -> None:
        if self.peek() == ";":
            self.i += 1
        elif not (self.new_line() or self.peek() in ("}", ")", "", "else", "->")):
            raise _Fail

    # types
    def type_(self, field: str | None = None) -> Node:
        if self.peek() == "(":
            kids = [self.leaf()]
            while self.peek() != ")":
                if self.kind() == "id" and self.peek(1) == ":":
                    kids += [self.identifier(), self.leaf()]
                kids.append(self.type_())
                if self.peek() == ",":
                    kids.append(self.leaf())
            kids.append(self.leaf())
            if self.peek() == "->":
                n = self.make("function_type", [*kids, self.leaf(), self.type_()])
            else:
                n = self.make("parenthesized_type", kids)
        else:
            kids = [self.identifier("type_identifier")]
            while True:
                if self.peek() == "<":
                    kids.append(self.type_arguments())
                elif self.peek() == "." and self.kind(1) == "id":
                    kids += [self.leaf(), self.identifier("type_identifier")]
                else:
                    break
            n = self.make("user_type", kids)
        if self.peek() == "?" and not self.new_line():
            n = self.make("nullable_type", [n, self.leaf()])
        return n

    def type_arguments(self, field: str | None = None) -> Node:
        kids = [self.want("<")]
        while self.peek() != ">":
            if self.peek() in ("*", "in", "out"):
                kids.append(self.leaf())
                if self.peek() in (",", ">"):
                    if self.peek() == ",":
                        kids.append(self.leaf())
                    continue
            kids.append(self.type_())
            if self.peek() == ",":
                kids.append(self.leaf())
            elif self.peek() != ">":
                raise _Fail
        return self.make("type_arguments", [*kids, self.leaf()])

    # expressions
    def expression(self, field: str | None = None) -> Node:
        return self.binary(0)

    def binary(self, level: int) -> Node:
        if level == len(LEVELS):
            return self.unary()
        name, ops = LEVELS[level]
        left = self.binary(level + 1)
        while True:
            t = self.peek()
            if name == "infix_expression":
                if self.kind() != "id" or t in HARD or self.new_line() or t in MODIFIERS and t != "infix" or self.peek(1) in (":", "="):
                    return left
                left = self.make(name, [left, self.identifier(), self.binary(level + 1)])
                continue
            if t == "!" and self.peek(1) in ("in", "is") and name == "check_expression":
                left = self.make(name, [left, self.leaf(), self.leaf(), self.type_() if self.toks[self.i - 1][1] == "is" else self.binary(level + 1)])
                continue
            if self.kind() not in ("op", "id") or t not in ops or self.new_line() and t not in ("||", "&&", "?:", "as"):
                return left
            op = self.leaf()
            if op.kind == "as" and self.peek() == "?":
                op = Node("as?", op.start, self.leaf().end, False)
            left = self.make(name, [left, op, self.type_() if op.kind in ("is", "as", "as?") else self.binary(level + 1)])

    def unary(self) -> Node:
        t = self.peek()
        if self.kind() == "op" and t in ("!", "-", "+", "++", "--"):
            return self.make("prefix_expression", [self.leaf(), self.unary()])
        return self.postfix(self.primary())

    def primary(self) -> Node:
        k, t = self.kind(), self.peek()
        if k == "num":
            return self.leaf("real_literal" if "." in t or t[-1] in "fF" and not t.startswith("0x") else "long_literal" if t.endswith("L") else "integer_literal")
        if k == "text":
            return self.leaf("string_literal")
        if k == "char":
            return self.leaf("character_literal")
        if t in ("true", "false"):
            return self.leaf("boolean_literal")
        if t == "null":
            return self.leaf("null")
        if t in ("this", "super"):
            kids = [self.leaf()]
            if self.peek() == "@":
                kids += [self.leaf(), self.identifier()]
            return self.make(f"{t}_expression", kids)
        if t == "(":
            held, self.no_lambda = self.no_lambda, 0
            n = self.make("parenthesized_expression", [self.leaf(), self.expression(), self.want(")")])
            self.no_lambda = held
            return n
        if t == "if":
            return self.if_()
        if t == "when":
            return self.when_()
        if t == "try":
            return self.try_()
        if t in ("return", "throw", "break", "continue"):
            kids: list[Node | None] = [self.leaf()]
            if self.peek() == "@" and not self.new_line():
                kids += [self.leaf(), self.identifier("label")]
            if t in ("return", "throw") and not self.new_line() and self.peek() not in ("}", ")", ";", "", "else", ","):
                kids.append(self.expression())
            return self.make("jump_expression", kids)
        if t == "{":
            return self.lambda_()
        if t == "object":
            kids = [self.leaf()]
            if self.peek() == ":":
                kids += [self.leaf(), *self.supertypes()]
            return self.make("object_literal", [*kids, self.class_body_()])
        if t == "fun":
            kids = [self.leaf(), self.value_parameters()]
            if self.peek() == ":":
                kids += [self.leaf(), self.type_()]
            return self.make("anonymous_function", [*kids, self.function_body()])
        if t == "::":
            return self.make("callable_reference", [self.leaf(), self.leaf("simple_identifier")])
        return self.identifier()

    def lambda_(self) -> Node:
        held, self.no_lambda = self.no_lambda, 0
        kids: list[Node | None] = [self.want("{")]
        at = self.i
        try:
            params: list[Node] = []
            while True:
                if self.peek() == "(":
                    params.append(self.make("multi_variable_declaration", self.names()))
                else:
                    params.append(self.variable())
                if self.peek() != ",":
                    break
                params.append(self.leaf())
            arrow = self.want("->")
            kids += [self.make("lambda_parameters", params), arrow]
        except _Fail:
            self.i = at
        kids.append(self.statements("}"))
        kids.append(self.want("}"))
        self.no_lambda = held
        return self.make("lambda_literal", kids)

    def names(self) -> list[Node]:
        kids = [self.want("(")]
        while self.peek() != ")":
            kids.append(self.variable())
            if self.peek() == ",":
                kids.append(self.leaf())
        return [*kids, self.leaf()]

    def variable(self) -> Node:
        kids = [self.identifier()]
        if self.peek() == ":":
            kids += [self.leaf(), self.type_()]
        return self.make("variable_declaration", kids)

    def value_arguments(self) -> Node:
        held, self.no_lambda = self.no_lambda, 0
        kids = [self.want("(")]
        while self.peek() != ")":
            arg: list[Node] = []
            if self.kind() == "id" and self.peek(1) == "=" and self.peek() not in HARD:
                arg += [self.identifier(), self.leaf()]
            if self.peek() == "*":
                arg.append(self.leaf())
            arg.append(self.expression())
            kids.append(self.make("value_argument", arg))
            if self.peek() == ",":
                kids.append(self.leaf())
            elif self.peek() != ")":
                raise _Fail
        self.no_lambda = held
        return self.make("value_arguments", [*kids, self.leaf()])

    def generic_call(self) -> Node:
        t = self.type_arguments()
        if self.peek() not in ("(", "{"):
            raise _Fail
        return t

    def postfix(self, x: Node) -> Node:
        while True:
            t = self.peek()
            if self.kind() != "op" or self.new_line() and t not in (".", "?."):
                return x
            targs = self.attempt(self.generic_call) if t == "<" else None
            t = self.peek()
            if t == "(":
                suffix: list[Node | None] = [targs, self.value_arguments()]
                if self.peek() == "{" and not self.no_lambda and not self.new_line():
                    suffix.append(self.make("annotated_lambda", [self.lambda_()]))
                x = self.make("call_expression", [x, self.make("call_suffix", suffix)])
            elif t == "{" and not self.no_lambda and x.kind in ("simple_identifier", "navigation_expression", "call_expression"):
                x = self.make("call_expression", [x, self.make("call_suffix", [targs, self.make("annotated_lambda", [self.lambda_()])])])
            elif t in (".", "?.", "::"):
                op = self.leaf()
                name = self.leaf("simple_identifier") if self.kind() == "id" else None
                if name is None:
                    raise _Fail
                x = self.make("callable_reference" if op.kind == "::" else "navigation_expression", [x, self.make("navigation_suffix", [op, name])])
            elif t == "[":
                kids = [self.leaf(), self.expression()]
                while self.peek() == ",":
                    kids += [self.leaf(), self.expression()]
                x = self.make("indexing_expression", [x, self.make("indexing_suffix", [*kids, self.want("]")])])
            elif t in ("++", "--", "!!"):
                x = self.make("postfix_expression", [x, self.leaf()])
            else:
                return x

    def body(self) -> Node:
        if self.peek() == "{":
            return self.make("control_structure_body", [self.leaf(), self.statements("}"), self.want("}")])
        if self.peek() == ";":
            return self.make("control_structure_body", [self.leaf()])
        return self.make("control_structure_body", [self.statement()])

    def condition(self) -> list[Node]:
        held, self.no_lambda = self.no_lambda, 0
        kids = [self.want("("), self.expression(), self.want(")")]
        self.no_lambda = held
        return kids

    def if_(self) -> Node:
        kids = [self.leaf(), *self.condition()]
        if self.peek() != "else":
            kids.append(self.body())
        at = self.i
        if self.peek() == ";" and self.peek(1) == "else":
            self.i += 1
        if self.peek() == "else":
            kids += [self.leaf(), self.body()]
        else:
            self.i = at
        return self.make("if_expression", kids)

    def when_(self) -> Node:
        kids: list[Node] = [self.leaf()]
        if self.peek() == "(":
            s = [self.leaf()]
            if self.peek() == "val":
                s += [self.leaf(), self.variable(), self.want("=")]
            kids.append(self.make("when_subject", [*s, self.expression(), self.want(")")]))
        kids.append(self.want("{"))
        while self.peek() != "}":
            entry: list[Node] = []
            while self.peek() != "->":
                if self.peek() == "else":
                    entry.append(self.leaf())
                elif self.peek() in ("in", "is") or self.peek() == "!" and self.peek(1) in ("in", "is"):
                    c = [self.leaf()]
                    if c[0].kind == "!":
                        c.append(self.leaf())
                    entry.append(self.make("when_condition", [*c, self.type_() if c[-1].kind == "is" else self.expression()]))
                else:
                    entry.append(self.make("when_condition", [self.expression()]))
                if self.peek() == ",":
                    entry.append(self.leaf())
                elif self.peek() != "->":
                    raise _Fail
            entry += [self.leaf(), self.body()]
            if self.peek() == ";":
                self.i += 1
            kids.append(self.make("when_entry", entry))
        return self.make("when_expression", [*kids, self.leaf()])

    def try_(self) -> Node:
        kids = [self.leaf(), self.want("{"), self.statements("}"), self.want("}")]
        while self.peek() == "catch":
            kids.append(self.make("catch_block", [self.leaf(), self.want("("), self.identifier(), self.want(":"), self.type_(), self.want(")"), self.want("{"), self.statements("}"), self.want("}")]))
        if self.peek() == "finally":
            kids.append(self.make("finally_block", [self.leaf(), self.want("{"), self.statements("}"), self.want("}")]))
        return self.make("try_expression", [k for k in kids if k is not None])

    # statements and declarations
    def statements(self, close: str) -> Node | None:
        kids = self.until(close, self.line)
        return self.make("statements", kids) if kids else None

    def line(self) -> Node:
        n = self.statement()
        self.end()
        return n

    def statement_(self) -> Node:
        t = self.peek()
        declared = self.attempt(self.declaration)
        if declared is not None:
            return declared
        if t == "for":
            kids = [self.leaf(), self.want("(")]
            kids += [self.make("multi_variable_declaration", self.names())] if self.peek() == "(" else [self.variable()]
            return self.make("for_statement", [*kids, self.want("in"), self.expression(), self.want(")"), self.body()])
        if t == "while":
            return self.make("while_statement", [self.leaf(), *self.condition(), self.body()])
        if t == "do":
            return self.make("do_while_statement", [self.leaf(), self.body(), self.want("while"), *self.condition()])
        x = self.expression()
        if self.kind() == "op" and self.peek() in ("=", "+=", "-=", "*=", "/=", "%=") and not self.new_line():
            left = self.make("directly_assignable_expression", [x])
            return self.make("assignment", [left, self.leaf(), self.expression()])
        return x

    def modifiers(self) -> Node | None:
        kids = []
        while True:
            if self.peek() == "@" and self.kind(1) == "id":
                a = [self.leaf()]
                if self.peek(1) == ":":
                    a.append(self.make("use_site_target", [self.leaf(), self.leaf()]))
                t = self.type_()
                a.append(self.make("constructor_invocation", [t, self.value_arguments()]) if self.peek() == "(" and not self.new_line() else t)
                kids.append(self.make("annotation", a))
            elif self.peek() in MODIFIERS and self.kind(1) in ("id", "op") and self.peek(1) not in (".", "(", "=", ":", ",", ")", "?.", "->", "[", "++", "--", "+", "-", "!!"):
                kids.append(self.leaf("modifier"))
            else:
                return self.make("modifiers", kids) if kids else None

    def declaration(self) -> Node:
        mods = self.modifiers()
        t = self.peek()
        if t in ("class", "interface") or t == "fun" and self.peek(1) == "interface":
            return self.class_(mods)
        if t == "object" and (self.kind(1) == "id" or mods is not None):
            kids: list[Node | None] = [mods, self.leaf()]
            if self.kind() == "id":
                kids.append(self.identifier("type_identifier"))
            if self.peek() == ":":
                kids += [self.leaf(), *self.supertypes()]
            if self.peek() == "{":
                kids.append(self.class_body_())
            companion = mods is not None and any("companion" == self.text_of(m) for m in mods.children)
            return self.make("companion_object" if companion else "object_declaration", kids)
        if t == "fun":
            return self.function(mods)
        if t in ("val", "var"):
            return self.property(mods)
        if t == "typealias":
            return self.make("type_alias", [mods, self.leaf(), self.identifier("type_identifier"), self.want("="), self.type_()])
        if t == "init" and self.peek(1) == "{":
            return self.make("anonymous_initializer", [self.leaf(), self.want("{"), self.statements("}"), self.want("}")])
        if t == "constructor":
            kids = [mods, self.leaf(), self.value_parameters()]
            if self.peek() == ":":
                kids += [self.leaf(), self.make("constructor_delegation_call", [self.leaf(), self.value_arguments()])]
            if self.peek() == "{":
                kids += [self.leaf(), self.statements("}"), self.want("}")]
            return self.make("secondary_constructor", kids)
        raise _Fail

    def text_of(self, n: Node) -> str:
        return next((t for _, t, s, e in self.toks if (s, e) == (n.start, n.end)), "")

    def supertypes(self) -> list[Node]:
        out = []
        while True:
            t: Node = self.type_()
            if self.peek() == "(":
                t = self.make("constructor_invocation", [t, self.value_arguments()])
            elif self.peek() == "by":
                t = self.make("explicit_delegation", [t, self.leaf(), self.expression()])
            out.append(self.make("delegation_specifier", [t]))
            if self.peek() != ",":
                return out
            out.append(self.leaf())

    def type_parameters(self) -> Node | None:
        if self.peek() != "<":
            return None
        kids = [self.leaf()]
        while self.peek() != ">":
            p: list[Node | None] = [self.modifiers()]
            if self.peek() in ("in", "out"):
                p.append(self.leaf())
            p.append(self.identifier("type_identifier"))
            if self.peek() == ":":
                p += [self.leaf(), self.type_()]
            kids.append(self.make("type_parameter", p))
            if self.peek() == ",":
                kids.append(self.leaf())
        return self.make("type_parameters", [*kids, self.leaf()])

    def class_(self, mods: Node | None) -> Node:
        enum = mods is not None and any(self.text_of(m) == "enum" for m in mods.children)
        kids: list[Node | None] = [mods]
        while self.peek() in ("fun", "class", "interface"):
            kids.append(self.leaf())
        kids += [self.identifier("type_identifier"), self.type_parameters()]
        ctor: list[Node | None] = []
        if self.peek() in ("private", "internal", "protected", "public", "@", "constructor"):
            ctor = [self.modifiers(), self.want("constructor")]
        if self.peek() == "(":
            ctor.append(self.class_parameters())
        if ctor:
            kids.append(self.make("primary_constructor", ctor))
        if self.peek() == ":":
            kids += [self.leaf(), *self.supertypes()]
        if self.peek() == "where":
            kids.append(self.constraints())
        if self.peek() == "{":
            kids.append(self.enum_body_() if enum else self.class_body_())
        return self.make("class_declaration", kids)

    def class_parameters(self) -> Node:
        kids = [self.want("(")]
        while self.peek() != ")":
            p: list[Node | None] = [self.modifiers()]
            if self.peek() in ("val", "var"):
                p.append(self.make("binding_pattern_kind", [self.leaf()]))
            p += [self.identifier(), self.want(":"), self.type_()]
            if self.peek() == "=":
                p += [self.leaf(), self.expression()]
            kids.append(self.make("class_parameter", p))
            if self.peek() == ",":
                kids.append(self.leaf())
        return self.make("class_parameters", [*kids, self.leaf()])

    def class_body_(self) -> Node:
        return self.make("class_body", [self.want("{"), *self.until("}", self.member), self.want("}")])

    def member(self) -> Node:
        n = self.declaration()
        if self.peek() == ";":
            self.i += 1
        return n

    def enum_body_(self) -> Node:
        kids = [self.want("{")]
        while self.peek() not in (";", "}"):
            e: list[Node | None] = [self.modifiers(), self.identifier()]
            if self.peek() == "(":
                e.append(self.value_arguments())
            if self.peek() == "{":
                e.append(self.class_body_())
            kids.append(self.make("enum_entry", e))
            if self.peek() == ",":
                kids.append(self.leaf())
            elif self.peek() not in (";", "}"):
                raise _Fail
        if self.peek() == ";":
            kids.append(self.leaf())
            kids += self.until("}", self.member)
        return self.make("enum_class_body", [*kids, self.want("}")])

    def value_parameters(self) -> Node:
        kids = [self.want("(")]
        while self.peek() != ")":
            mods = self.modifiers()
            p: list[Node] = [self.identifier()]
            if self.peek() == ":":
                p += [self.leaf(), self.type_()]
            param = self.make("parameter", p)
            kids += [x for x in (mods, param) if x is not None]
            if self.peek() == "=":
                kids += [self.leaf(), self.expression()]
            if self.peek() == ",":
                kids.append(self.leaf())
            elif self.peek() != ")":
                raise _Fail
        return self.make("function_value_parameters", [*kids, self.leaf()])

    def function_body(self) -> Node:
        if self.peek() == "=":
            return self.make("function_body", [self.leaf(), self.expression()])
        return self.make("function_body", [k for k in (self.want("{"), self.statements("}"), self.want("}")) if k is not None])

    def function(self, mods: Node | None) -> Node:
        kids: list[Node | None] = [mods, self.leaf(), self.type_parameters()]
        receiver = self.attempt(self.receiver)
        if receiver is not None:
            kids += receiver
        kids += [self.identifier(), self.value_parameters()]
        if self.peek() == ":":
            kids += [self.leaf(), self.type_()]
        if self.peek() == "where":
            kids.append(self.constraints())
        if self.peek() in ("{", "="):
            kids.append(self.function_body())
        return self.make("function_declaration", kids)

    def constraints(self) -> Node:
        kids = [self.leaf()]
        while True:
            kids.append(self.make("type_constraint", [self.identifier("type_identifier"), self.want(":"), self.type_()]))
            if self.peek() != ",":
                return self.make("type_constraints", kids)
            kids.append(self.leaf())

    def receiver(self) -> list[Node]:
        t = self.identifier("type_identifier")
        kids = [t, self.type_arguments()] if self.peek() == "<" else [t]
        n = self.make("user_type", kids)
        if self.peek() == "?":
            n = self.make("nullable_type", [n, self.leaf()])
        return [n, self.want(".") if self.peek() == "." else self.want("?.")]

    def property(self, mods: Node | None) -> Node:
        kids: list[Node | None] = [mods, self.make("binding_pattern_kind", [self.leaf()]), self.type_parameters()]
        receiver = self.attempt(self.receiver)
        if receiver is not None:
            kids += receiver
        kids.append(self.make("multi_variable_declaration", self.names()) if self.peek() == "(" else self.variable())
        if self.peek() == "=":
            kids += [self.leaf(), self.expression()]
        elif self.peek() == "by":
            kids.append(self.make("property_delegate", [self.leaf(), self.expression()]))
        while self.peek() in ("get", "set") and self.peek(1) in ("(", "=", "{"):
            kind = "getter" if self.peek() == "get" else "setter"
            g: list[Node | None] = [self.leaf(), self.want("(")]
            if self.peek() != ")":
                g.append(self.variable())
            g.append(self.want(")"))
            if self.peek() == ":":
                g += [self.leaf(), self.type_()]
            kids.append(self.make(kind, [*g, self.function_body()]))
        return self.make("property_declaration", kids)

    def top(self) -> Node:
        t = self.peek()
        if t in ("package", "import"):
            kids: list[Node] = [self.leaf()]
            ids = [self.leaf("simple_identifier")]
            while self.peek() == ".":
                ids += [self.leaf(), self.leaf("simple_identifier") if self.kind() == "id" else self.leaf()]
            kids.append(self.make("identifier", ids))
            if self.peek() == "as":
                kids.append(self.make("import_alias", [self.leaf(), self.identifier("type_identifier")]))
            n = self.make("package_header" if t == "package" else "import_header", kids)
        else:
            n = self.statement()
        self.end()
        return n


def parse_kotlin(code: str) -> Tree:
    p = KotlinParser(code)
    items: list[Node] = []
    while p.i < len(p.toks):
        got = p.until("", p.top)
        if not got:
            break
        items += got
    root = Node("source_file", 0, p.length, children=items)
    attach(root, p.comments)
    return Tree(code, root)
