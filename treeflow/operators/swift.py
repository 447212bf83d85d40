"""A parser for Swift, on the token and expression machinery of the Kotlin parser."""

from __future__ import annotations

import re

from .java import _Fail, attach
from .kotlin import KotlinParser
from .trees import Node, Tree

TOKEN = re.compile(
    r"""(?P<line>//[^\n]*|\#(?:if|else|elseif|endif)[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<text>\"\"\".*?\"\"\"|"(?:\\\((?:[^()\n]|\([^()\n]*\))*\)|\\.|[^"\\\n])*")
    |(?P<num>0x[0-9a-fA-F_]+|0b[01_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)|(?P<id>[^\W\d]\w*|`[^`\n]+`|\$\d+|\#[a-z]\w*)
    |(?P<op>===|!==|\.\.\.|\.\.<|\?\?|->|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|\?\.|[-+*/%&|^!<>=?:;,.(){}\[\]@#~\\])|(?P<bad>\S)""",
    re.S | re.X,
)
HARD = frozenset("as break case catch class continue default defer deinit do else enum extension fallthrough false for func guard if import in init inout is let nil operator protocol repeat return self static struct subscript super switch throw throws true try typealias var where while".split())
MODIFIERS = frozenset("public private fileprivate internal open final static override lazy weak unowned mutating nonmutating required convenience optional dynamic indirect prefix postfix async".split())
BINARY = [("disjunction_expression", ("||",)), ("conjunction_expression", ("&&",)), ("equality_expression", ("==", "!=", "===", "!==")), ("comparison_expression", ("<", ">", "<=", ">=")), ("nil_coalescing_expression", ("??",)), ("check_expression", ("is",)), ("range_expression", ("...", "..<")), ("additive_expression", ("+", "-", "|", "^")), ("multiplicative_expression", ("*", "/", "%", "&")), ("as_expression", ("as",))]


class SwiftParser(KotlinParser):
    lex = TOKEN

    def __init__(self, code: str):
        at = pos = 0
        self.toks, self.comments, self.fresh = [], [], set()
        broke = False
        for m in self.lex.finditer(code):
            between = code[pos : m.start()]
            at += len(between.encode())
            size, pos, kind = len(m[0].encode()), m.end(), m.lastgroup
            broke = broke or "\n" in between
            if kind in ("line", "block"):
                self.comments.append(Node("comment" if kind == "line" else "multiline_comment", at, at + size))
                broke = broke or "\n" in m[0]
            else:
                if broke:
                    self.fresh.add(at)
                broke = False
                self.toks.append((kind, m[0], at, at + size))
            at += size
        self.length, self.i, self.no_lambda = len(code.encode()), 0, 0

    def identifier(self, kind: str = "simple_identifier", field: str | None = None) -> Node:
        if self.kind() != "id" or self.peek() in HARD or self.peek().startswith("#"):
            raise _Fail
        return self.leaf(kind, field)

    def glued(self) -> bool:
        """The next token follows its neighbour without white space."""
        return 0 < self.i < len(self.toks) and self.toks[self.i - 1][3] == self.toks[self.i][2]

    # types
    def type_(self, field: str | None = None) -> Node:
        while self.peek() == "@" or self.peek() == "inout":
            self.i += 1 if self.peek() == "inout" else 2
        if self.peek() == "(":
            kids = [self.leaf()]
            while self.peek() != ")":
                if self.kind() == "id" and self.peek(1) == ":" or self.kind(1) == "id" and self.peek(2) == ":":
                    while self.peek() != ":":
                        kids.append(self.leaf("simple_identifier"))
                    kids.append(self.leaf())
                kids.append(self.type_())
                if self.peek() in (",", "..."):
                    kids.append(self.leaf())
            n = self.make("tuple_type", [*kids, self.leaf()])
        elif self.peek() == "[":
            kids = [self.leaf(), self.type_()]
            if self.peek() == ":":
                n = self.make("dictionary_type", [*kids, self.leaf(), self.type_(), self.want("]")])
            else:
                n = self.make("array_type", [*kids, self.want("]")])
        else:
            kids = [self.leaf() if self.peek() in ("some", "any") and self.kind(1) == "id" else None]
            kids.append(self.identifier("type_identifier"))
            while True:
                if self.peek() == "<":
                    a = [self.leaf(), self.type_()]
                    while self.peek() == ",":
                        a += [self.leaf(), self.type_()]
                    kids.append(self.make("type_arguments", [*a, self.want(">")]))
                elif self.peek() in (".", "&") and self.kind(1) == "id":
                    kids += [self.leaf(), self.leaf("type_identifier")]
                else:
                    break
            n = self.make("user_type", kids)
        while self.peek() in ("?", "!") and self.glued():
            n = self.make("optional_type", [n, self.leaf()])
        if self.peek() in ("throws", "->", "async"):
            kids = [n]
            while self.peek() in ("throws", "async"):
                kids.append(self.leaf())
            n = self.make("function_type", [*kids, self.want("->"), self.type_()])
        n.field = field
        return n

    # expressions
    def expression(self, field: str | None = None) -> Node:
        if self.peek() in ("try", "await"):
            k = [self.leaf()]
            if self.peek() in ("?", "!") and self.glued():
                k.append(self.leaf())
            n = self.make(f"{k[0].kind}_expression", [*k, self.expression()])
        else:
            n = self.binary(0)
            if self.peek() == "?" and self.kind() == "op" and not self.glued():
                n.field = "condition"
                q = self.leaf()
                yes = self.expression("if_true")
                n = self.make("ternary_expression", [n, q, yes, self.want(":"), self.expression("if_false")])
        n.field = field
        return n

    def binary(self, level: int) -> Node:
        if level == len(BINARY):
            return self.unary()
        name, ops = BINARY[level]
        left = self.binary(level + 1)
        while self.kind() in ("op", "id") and self.peek() in ops:
            if self.new_line() and self.peek() in ("<", "-", "&"):
                return left
            left.field = "lhs"
            op = self.leaf(None, "op")
            if op.kind == "as" and self.peek() in ("?", "!"):
                op = Node(f"as{self.peek()}", op.start, self.leaf().end, False, "op")
            right = self.type_() if op.kind[:2] in ("as", "is") else self.binary(level + 1)
            right.field = "rhs"
            left = self.make(name, [left, op, right])
        return left

    def unary(self) -> Node:
        t = self.peek()
        if self.kind() == "op" and t in ("!", "-", "+", "~", "&"):
            op = self.leaf("bang" if t == "!" else None, "operation")
            x = self.unary()
            x.field = "target"
            return self.make("prefix_expression", [op, x])
        if t == "." and self.kind(1) == "id":
            return self.postfix(self.make("prefix_expression", [self.leaf(None, "operation"), self.leaf("simple_identifier", "target")]))
        return self.postfix(self.primary())

    def primary(self) -> Node:
        k, t = self.kind(), self.peek()
        if k == "num":
            return self.leaf("real_literal" if "." in t else "integer_literal")
        if k == "text":
            return self.leaf("line_string_literal")
        if t in ("true", "false"):
            return self.leaf("boolean_literal")
        if t == "nil":
            return self.leaf("nil")
        if t in ("self", "super"):
            return self.leaf(f"{t}_expression")
        if t in ("#available", "#unavailable") and self.peek(1) == "(":
            return self.make("availability_condition", [self.leaf(), *self.availability()])
        if t.startswith("#"):
            return self.leaf("special_literal")
        if t == "(":
            held, self.no_lambda = self.no_lambda, 0
            kids = [self.leaf()]
            while self.peek() != ")":
                if self.kind() == "id" and self.peek(1) == ":":
                    kids += [self.leaf("simple_identifier", "name"), self.leaf()]
                kids.append(self.expression("value"))
                if self.peek() == ",":
                    kids.append(self.leaf())
                elif self.peek() != ")":
                    raise _Fail
            self.no_lambda = held
            return self.make("tuple_expression", [*kids, self.leaf()])
        if t == "[":
            held, self.no_lambda = self.no_lambda, 0
            kids, kind = [self.leaf()], "array_literal"
            while self.peek() != "]":
                if self.peek() in (":", ","):
                    kind = "dictionary_literal" if self.peek() == ":" else kind
                    kids.append(self.leaf())
                else:
                    kids.append(self.expression("element"))
            self.no_lambda = held
            return self.make(kind, [*kids, self.leaf()])
        if t == "{":
            return self.lambda_()
        if t in ("if", "switch"):
            return self.statement()
        if t == "\\" and self.peek(1) == ".":
            return self.make("key_path_expression", [self.leaf(), self.leaf(), self.leaf("simple_identifier")])
        return self.identifier()

    def lambda_(self) -> Node:
        held, self.no_lambda = self.no_lambda, 0
        kids: list[Node | None] = [self.want("{")]
        j, depth = self.i, 0
        while j < len(self.toks) and self.toks[j][1] not in ("{", "}") and not (self.toks[j][1] == "in" and depth == 0):
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(self.toks[j][1], 0)
            j += 1
        if j < len(self.toks) and self.toks[j][1] == "in" and depth == 0 and not any(t[1] in ("for", "=") for t in self.toks[self.i : j]):
            head = []
            while self.i < j:
                head.append(self.leaf("simple_identifier" if self.kind() == "id" and self.peek() not in HARD else None))
            kids += [self.make("lambda_function_type", head) if head else None, self.leaf()]
        kids += [self.statements("}"), self.want("}")]
        self.no_lambda = held
        return self.make("lambda_literal", kids)

    def value_arguments(self) -> Node:
        held, self.no_lambda = self.no_lambda, 0
        close = ")" if self.peek() == "(" else "]"
        kids = [self.leaf()]
        while self.peek() != close:
            arg: list[Node] = []
            if self.kind() == "id" and self.peek(1) == ":":
                arg += [self.leaf("simple_identifier", "name"), self.leaf()]
            while self.peek() in ("let", "var"):  # a pattern that binds
                arg.append(self.leaf())
            arg.append(self.expression("value"))
            kids.append(self.make("value_argument", arg))
            if self.peek() == ",":
                kids.append(self.leaf())
            elif self.peek() != close:
                raise _Fail
        self.no_lambda = held
        return self.make("value_arguments", [*kids, self.leaf()])

    def generic_call(self) -> Node:
        a = [self.want("<"), self.type_()]
        while self.peek() == ",":
            a += [self.leaf(), self.type_()]
        t = self.make("type_arguments", [*a, self.want(">")])
        if self.peek() not in ("(", ".", "{"):
            raise _Fail
        return t

    def postfix(self, x: Node) -> Node:
        while True:
            t = self.peek()
            if self.kind() != "op" or self.new_line() and t not in (".", "?."):
                return x
            targs = self.attempt(self.generic_call) if t == "<" and self.glued() else None
            t = self.peek()
            if t in ("(", "[") and self.glued() or t == "(" and targs is not None:
                suffix: list[Node | None] = [targs, self.value_arguments()]
                while self.peek() == "{" and not self.no_lambda:
                    suffix.append(self.lambda_())
                x = self.make("call_expression", [x, self.make("call_suffix", suffix)])
            elif t == "{" and not self.no_lambda and not self.new_line() and x.kind in ("simple_identifier", "navigation_expression"):
                x = self.make("call_expression", [x, self.make("call_suffix", [targs, self.lambda_()])])
            elif t in (".", "?."):
                op = self.leaf()
                if self.kind() not in ("id", "num"):
                    raise _Fail
                x.field = "target"
                x = self.make("navigation_expression", [x, self.make("navigation_suffix", [op, self.leaf("simple_identifier", "suffix")], "suffix")])
            elif t in ("!", "?") and self.glued() and not (t == "?" and self.peek(1) == "?"):
                x = self.make("postfix_expression", [x, self.leaf("bang" if t == "!" else None, "operation")])
            else:
                return x

    # statements
    def block(self, field: str | None = None) -> list[Node | None]:
        return [self.want("{"), self.statements("}"), self.want("}")]

    def conditions(self) -> list[Node]:
        self.no_lambda += 1
        kids: list[Node] = []
        try:
            while True:
                if self.peek() in ("let", "var", "case"):
                    bind: list[Node] = [self.leaf()]
                    if bind[0].kind == "case":
                        bind.append(self.make("pattern", [self.expression()]) if self.peek() not in ("let", "var") else self.make("pattern", [self.leaf(), self.expression()]))
                    else:
                        bind.append(self.identifier("simple_identifier", "bound_identifier"))
                        if self.peek() == ":":
                            bind += [self.leaf(), self.type_()]
                    if self.peek() == "=":
                        bind += [self.leaf(), self.expression()]
                    kids += [Node("value_binding_pattern", bind[0].start, bind[0].end, True, "condition", children=[bind[0]]), *bind[1:]]
                else:
                    kids.append(self.expression("condition"))
                if self.peek() != ",":
                    return kids
                kids.append(self.leaf())
        finally:
            self.no_lambda -= 1

    def end(self) -> None:
        if self.peek() == ";":
            self.i += 1
        elif not (self.new_line() or self.peek() in ("}", ")", "", "case", "default")):
            raise _Fail

    def statement_(self) -> Node:
        t = self.peek()
        declared = self.attempt(self.declaration)
        if declared is not None:
            return declared
        if t == "if":
            kids: list[Node | None] = [self.leaf(), *self.conditions(), *self.block()]
            if self.peek() == "else":
                kids.append(self.leaf("else"))
                kids += [self.statement()] if self.peek() == "if" else self.block()
            return self.make("if_statement", kids)
        if t == "guard":
            return self.make("guard_statement", [self.leaf(), *self.conditions(), self.leaf("else") if self.peek() == "else" else self.want("else"), *self.block()])
        if t in ("return", "throw", "break", "continue", "fallthrough", "yield") and not (t == "yield" and self.peek(1) in (".", "(", "=")):
            kids = [self.leaf()]
            if not self.new_line() and self.peek() not in ("}", ";", "", "case", "default"):
                kids.append(self.expression("result"))
            return self.make("control_transfer_statement", kids)
        if t == "for":
            kids = [self.leaf()]
            while self.peek() in ("case", "let", "var"):
                kids.append(self.leaf())
            kids.append(self.make("pattern", [self.expression()], "item"))
            self.no_lambda += 1
            kids += [self.want("in"), self.expression("collection")]
            if self.peek() == "where":
                kids.append(self.make("where_clause", [self.leaf(), self.expression()]))
            self.no_lambda -= 1
            return self.make("for_statement", [*kids, *self.block()])
        if t == "while":
            return self.make("while_statement", [self.leaf(), *self.conditions(), *self.block()])
        if t == "repeat":
            return self.make("repeat_while_statement", [self.leaf(), *self.block(), self.want("while"), self.expression("condition")])
        if t in ("do", "defer"):
            kids = [self.leaf(), *self.block()]
            while self.peek() == "catch":
                c: list[Node | None] = [self.leaf()]
                if self.peek() != "{":
                    c += self.conditions()
                kids.append(self.make("catch_block", [*c, *self.block()]))
            return self.make(f"{t}_statement", kids)
        if t == "switch":
            return self.switch_()
        x = self.expression()
        if self.kind() == "op" and self.peek() in ("=", "+=", "-=", "*=", "/=", "%="):
            left = self.make("directly_assignable_expression", [x], "target")
            return self.make("assignment", [left, self.leaf(None, "operator"), self.expression("result")])
        return x

    def switch_(self) -> Node:
        self.no_lambda += 1
        kids: list[Node] = [self.leaf(), self.expression("expr")]
        self.no_lambda -= 1
        kids.append(self.want("{"))
        while self.peek() != "}":
            entry: list[Node | None] = []
            if self.peek() == "@":
                entry += [self.leaf(), self.leaf("simple_identifier")]
            if self.peek() == "default":
                entry.append(self.leaf("default_keyword"))
            else:
                entry.append(self.want("case"))
                while True:
                    p: list[Node] = []
                    while self.peek() in ("let", "var", "is"):
                        p.append(self.leaf())
                    entry.append(self.make("switch_pattern", [self.make("pattern", [*p, self.expression()])]))
                    if self.peek() == "where":
                        entry.append(self.make("where_clause", [self.leaf(), self.expression()]))
                    if self.peek() != ",":
                        break
                    entry.append(self.leaf())
            entry.append(self.want(":"))
            body: list[Node] = []
            while self.peek() not in ("case", "default", "}") and not (self.peek() == "@" and self.peek(1) == "unknown"):
                body.append(self.line())
            entry.append(self.make("statements", body) if body else None)
            kids.append(self.make("switch_entry", entry))
        return self.make("switch_statement", [*kids, self.leaf()])

    # declarations
    def availability(self) -> list[Node]:
        """Platforms with versions, and messages, in brackets."""
        kids = [self.want("(")]
        while self.peek() != ")":
            if self.kind() not in ("id", "num", "text") and self.peek() not in ("*", ",", ":", "."):
                raise _Fail
            kids.append(self.leaf({"id": "simple_identifier", "num": "integer_literal", "text": "line_string_literal"}.get(self.kind())))
        return [*kids, self.leaf()]

    def modifiers(self) -> Node | None:
        kids = []
        while True:
            if self.peek() == "@" and self.kind(1) == "id" and self.peek(1) != "unknown":
                a = [self.leaf(), self.type_()]
                if self.peek() == "(" and self.text_of(a[1]) == "available":
                    a += self.availability()
                elif self.peek() == "(" and self.glued():
                    a.append(self.value_arguments())
                kids.append(self.make("attribute", a))
            elif self.peek() in MODIFIERS and self.kind(1) in ("id", "op") and self.peek(1) not in (".", "=", ":", ",", ")", "?."):
                m = [self.leaf()]
                if self.peek() == "(":
                    m += [self.leaf(), self.leaf(), self.want(")")]
                kids.append(self.make("modifier", m))
            elif self.peek() == "class" and self.peek(1) in ("func", "var", "let", "override", "final"):
                kids.append(self.make("modifier", [self.leaf()]))
            else:
                return self.make("modifiers", kids) if kids else None

    def declaration(self) -> Node:
        mods = self.modifiers()
        t = self.peek()
        if t == "import":
            kids: list[Node | None] = [mods, self.leaf()]
            ids = [self.leaf("simple_identifier")]
            while self.peek() == "." or self.kind() == "id" and not self.new_line():
                ids.append(self.leaf("simple_identifier" if self.kind() == "id" else None))
            return self.make("import_declaration", [*kids, self.make("identifier", ids)])
        if t in ("class", "struct", "enum", "extension", "protocol", "actor") and self.kind(1) == "id":
            kids = [mods, self.leaf(None, "declaration_kind"), self.type_("name") if t == "extension" else self.identifier("type_identifier", "name"), self.generics()]
            if self.peek() == ":":
                kids.append(self.leaf())
                while True:
                    kids.append(self.make("inheritance_specifier", [self.leaf("user_type") if self.peek() == "class" else self.type_("inherits_from")]))
                    if self.peek() != ",":
                        break
                    kids.append(self.leaf())
            kids.append(self.where())
            kind = "enum_class_body" if t == "enum" else "protocol_body" if t == "protocol" else "class_body"
            body = self.make(kind, [self.want("{"), *self.until("}", self.member), self.want("}")], "body")
            return self.make("protocol_declaration" if t == "protocol" else "class_declaration", [*kids, body])
        if t in ("func", "init", "deinit", "subscript"):
            kids = [mods, self.leaf()]
            if t == "func":
                kids.append(self.leaf("simple_identifier", "name"))
            while self.peek() in ("?", "!"):
                kids.append(self.leaf())
            kids.append(self.generics())
            if t != "deinit":
                kids += self.parameters_()
            while self.peek() in ("throws", "rethrows", "async"):
                kids.append(self.leaf())
            if self.peek() == "->":
                kids += [self.leaf(), self.type_("return_type")]
            kids.append(self.where())
            if self.peek() == "{":
                kids.append(self.make("function_body", self.block(), "body"))
            return self.make({"func": "function_declaration", "init": "init_declaration", "deinit": "deinit_declaration", "subscript": "subscript_declaration"}[t], kids)
        if t in ("let", "var"):
            kids = [mods, self.make("value_binding_pattern", [self.leaf()])]
            while True:
                name = self.make("pattern", [self.primary()] if self.peek() == "(" else [self.identifier("simple_identifier", "bound_identifier")], "name")
                kids.append(name)
                if self.peek() == ":":
                    kids.append(self.make("type_annotation", [self.leaf(), self.type_()]))
                if self.peek() == "=":
                    kids += [self.leaf(), self.expression("value")]
                if self.peek() == "{" and not self.no_lambda:
                    kids.append(self.computed())
                if self.peek() != ",":
                    return self.make("property_declaration", kids)
                kids.append(self.leaf())
        if t in ("typealias", "associatedtype"):
            kids = [mods, self.leaf(), self.identifier("type_identifier", "name")]
            if self.peek() == ":":
                kids += [self.leaf(), self.type_()]
            if self.peek() == "=":
                kids += [self.leaf(), self.type_("value")]
            return self.make(f"{t}_declaration", kids)
        raise _Fail

    def computed(self) -> Node:
        kids: list[Node | None] = [self.want("{")]
        if self.peek() in ("get", "set", "willSet", "didSet") and self.peek(1) in ("{", "(", "}", "set"):
            while self.peek() != "}":
                g: list[Node | None] = [self.leaf()]
                if self.peek() == "(":
                    g += [self.leaf(), self.identifier(), self.want(")")]
                if self.peek() == "{":
                    g += self.block()
                kids.append(self.make(f"computed_{g[0].kind.lower()}", g))
        else:
            kids.append(self.statements("}"))
        return self.make("computed_property", [*kids, self.want("}")], "computed_value")

    def generics(self) -> Node | None:
        if self.peek() != "<":
            return None
        kids = [self.leaf()]
        while self.peek() != ">":
            p: list[Node] = [self.identifier("type_identifier")]
            if self.peek() == ":":
                p += [self.leaf(), self.type_()]
            kids.append(self.make("type_parameter", p))
            if self.peek() == ",":
                kids.append(self.leaf())
        return self.make("type_parameters", [*kids, self.leaf()])

    def where(self) -> Node | None:
        if self.peek() != "where":
            return None
        kids = [self.leaf()]
        while self.peek() not in ("{", ""):
            kids.append(self.leaf("type_identifier" if self.kind() == "id" else None))
        return self.make("type_constraints", kids)

    def parameters_(self) -> list[Node]:
        kids = [self.want("(")]
        while self.peek() != ")":
            p: list[Node | None] = [self.modifiers(), self.leaf("simple_identifier", "external_name") if self.kind(1) == "id" and self.peek(1) != ":" else None, self.leaf("simple_identifier", "name"), self.want(":"), self.type_("type")]
            if self.peek() == "...":
                p.append(self.leaf())
            kids.append(self.make("parameter", p))
            if self.peek() == "=":
                kids += [self.leaf(), self.expression("default_value")]
            if self.peek() == ",":
                kids.append(self.leaf())
            elif self.peek() != ")":
                raise _Fail
        return [*kids, self.leaf()]

    def member(self) -> Node:
        if self.peek() == "case" or self.peek() == "indirect" and self.peek(1) == "case":
            kids: list[Node] = [self.leaf()]
            while not self.new_line() and self.peek() not in ("}", ""):
                if self.kind() == "id" and self.peek() not in HARD or self.kind() == "id" and self.peek() == "default":
                    kids.append(self.leaf("simple_identifier", "name"))
                    if self.peek() == "(":
                        kids.append(self.make("enum_type_parameters", [self.type_()]))
                elif self.peek() == "=":
                    kids += [self.leaf(), self.expression("raw_value")]
                elif self.peek() in (",", "case"):
                    kids.append(self.leaf())
                    if self.new_line():
                        self.fresh.discard(self.toks[self.i][2])
                else:
                    raise _Fail
            return self.make("enum_entry", kids)
        n = self.declaration()
        if self.peek() == ";":
            self.i += 1
        return n

    def top(self) -> Node:
        n = self.statement()
        self.end()
        return n


def parse_swift(code: str) -> Tree:
    p = SwiftParser(code)
    items: list[Node] = []
    while p.i < len(p.toks):
        got = p.until("", p.top)
        if not got:
            break
        items += got
    root = Node("source_file", 0, p.length, children=items)
    attach(root, p.comments)
    return Tree(code, root)
