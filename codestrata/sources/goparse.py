"""What a Go source file declares, calls and imports, in the order in which a tree walk meets it.

A recursive-descent reader of the language's grammar that keeps no tree. Everything is met in source order
but calls: a call stands before what it calls, so it is put in where its operand began. Function literals,
parameters, fields and short declarations declare nothing here; local var, const and type declarations do.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .golex import GoSyntaxError, Lines, Token, tokens

BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
UNARY = frozenset("+ - ! ^ * & <- ~".split())
KINDS = {"struct": "struct", "interface": "interface", "map": "map", "func": "func", "chan": "chan", "[": "array", "<-": "chan"}
ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", "'": "'", '"': '"'}
ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{3})|(.))", re.S)


def utf8(text: str) -> str:
    return text.encode("latin-1").decode("utf-8", "replace")


def unquote(literal: str) -> str | None:
    """The value of a string literal; None if it has none."""
    body = literal[1:-1]
    if literal[0] == "`":
        return utf8(body.replace("\r", ""))
    try:
        made = ESCAPE.sub(lambda m: chr(int(m[1] or m[4], 16 if m[1] else 8)) if m[1] or m[4] else chr(int(m[2] or m[3], 16)).encode().decode("latin-1") if m[2] or m[3] else ESCAPES[m[5]], body)
    except (KeyError, ValueError):
        return None
    return utf8(made)


@dataclass
class Parsed:
    """Rows as tuples that begin with line, col, match."""

    package: str = ""
    package_place: tuple[int, int] = (1, 1)
    file_place: tuple[int, int] = (1, 1)
    imports: list[tuple] = field(default_factory=list)  # path, alias
    types: list[tuple] = field(default_factory=list)  # name, kind
    functions: list[tuple] = field(default_factory=list)  # name, receiver
    variables: list[tuple] = field(default_factory=list)  # name, kind
    calls: list[tuple] = field(default_factory=list)  # callee
    error: tuple[str, str] | None = None  # position, message


class Parser:
    def __init__(self, data: bytes) -> None:
        self.source = data.decode("latin-1")
        if self.source.startswith("\xef\xbb\xbf"):
            self.source = "   " + self.source[3:]
        self.lines = Lines(self.source)
        self.tokens = tokens(self.source)
        self.i = 0
        self.level = 0  # below 0: in the head of a statement, where { opens the body
        self.found = Parsed()

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, k: int = 1) -> Token:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def at(self, *texts: str) -> bool:
        t = self.tokens[self.i]
        return t.kind in ("op", "keyword") and t.text in texts

    def take(self) -> Token:
        t = self.tokens[self.i]
        if t.kind != "end":
            self.i += 1
        return t

    def accept(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def expect(self, text: str) -> Token:
        if not self.at(text):
            raise GoSyntaxError(f"expected {text!r}, found {self.now.text or 'EOF'!r}", self.now.at)
        return self.take()

    def name(self) -> Token:
        if self.now.kind != "name":
            raise GoSyntaxError(f"expected a name, found {self.now.text or 'EOF'!r}", self.now.at)
        return self.take()

    def end_of_statement(self) -> None:
        if not self.at(")", "}") and self.now.kind != "end":
            self.expect(";")

    def place(self, at: int) -> tuple[int, int]:
        return self.lines.place(at)

    # files and declarations

    def file(self) -> Parsed:
        found = self.found
        try:
            self.expect("package")
            t = self.name()
            found.package, found.package_place = utf8(t.text), self.place(t.at)
            found.file_place = self.place(self.tokens[0].at)
            self.end_of_statement()
        except GoSyntaxError as e:
            self.report(e)
            return found
        while self.now.kind != "end":
            if self.accept(";"):
                continue
            try:
                self.declaration(top=True)
            except GoSyntaxError as e:
                self.report(e)
                self.go_on(e.at)
        found.types = [t for t in found.types if t]
        return found

    def report(self, e: GoSyntaxError) -> None:
        """Keep the file's first error."""
        if self.found.error is None:
            line, col = self.place(min(e.at, len(self.source)))
            self.found.error = (f"{line}:{col}", str(e))

    def go_on(self, after: int) -> None:
        """To the next declaration that begins a line after a syntax error, so that one costs no later rows."""
        self.level = 0
        while self.now.kind != "end":
            t = self.now
            if t.at > after and t.kind == "keyword" and t.text in ("func", "type", "var", "const", "import") and self.place(t.at)[1] == 1:
                return
            self.i += 1

    def declaration(self, top: bool) -> None:
        if self.at("import"):
            self.group(self.import_spec)
        elif self.at("type"):
            self.group(self.type_spec)
        elif self.at("const"):
            self.group(lambda: self.value_spec("const" if top else "var"))
        elif self.at("var"):
            self.group(lambda: self.value_spec("var"))
        elif self.at("func") and top:
            self.function()
        else:
            raise GoSyntaxError(f"unexpected {self.now.text or 'EOF'!r}", self.now.at)

    def group(self, spec) -> None:
        self.take()
        if self.accept("("):
            while not self.accept(")"):
                spec()
                self.end_of_statement()
        else:
            spec()
        self.end_of_statement()

    def import_spec(self) -> None:
        first, alias = self.now, ""
        if first.kind == "name":
            alias = utf8(self.take().text)
        elif self.accept("."):
            alias = "."
        if self.now.kind != "string":
            raise GoSyntaxError("missing import path", self.now.at)
        path = unquote(self.take().text)
        if path:
            self.found.imports.append((*self.place(first.at), path, alias))

    def type_spec(self) -> None:
        t = self.name()
        row = len(self.found.types)
        self.found.types.append(())
        if self.at("[") and self.has_type_parameters():
            self.take()
            self.parameters("]")
        self.accept("=")
        kind = "type" if self.now.kind == "name" else KINDS.get(self.now.text, "type")
        name = utf8(t.text)
        match = f"type {name}" + (f" {kind}" if kind != "type" else "")
        self.found.types[row] = (*self.place(t.at), match, name, kind)
        self.type()

    def has_type_parameters(self) -> bool:
        """Whether the [ after a type's name opens type parameters, and not an array's length."""
        first, second, third, fourth = (self.ahead(k) for k in range(1, 5))
        if first.kind != "name":
            return False
        if second.kind == "name" or second.kind == "keyword" or second.text in (",", "~", "(", "["):
            return not (second.text == "(" and self._closes_length(1))
        # [P *T] alone could be a product: it is read as a length, as the language does
        return second.text == "*" and not (third.kind in ("name", "number") and fourth.text == "]")

    def _closes_length(self, k: int) -> bool:
        """Whether the brackets from the k-th next token on hold one expression and an element type follows."""
        depth = 0
        for j in range(self.i, len(self.tokens)):
            text = self.tokens[j].text
            if text in ("[", "(", "{"):
                depth += 1
            elif text in ("]", ")", "}"):
                depth -= 1
                if not depth:
                    return not any(t.text == "," for t in self.tokens[self.i : j]) and self.tokens[j + 1].kind == "name"
        return False

    def value_spec(self, kind: str) -> None:
        while True:
            t = self.name()
            name = utf8(t.text)
            self.found.variables.append((*self.place(t.at), f"{kind} {name}", name, kind))
            if not self.accept(","):
                break
        if not self.at("=", ";", ")"):
            self.type()
        if self.accept("="):
            self.expressions()

    def function(self) -> None:
        start = self.take()
        receiver = ""
        if self.at("("):
            receiver = self.receiver()
        t = self.name()
        name = utf8(t.text)
        match = f"func ({receiver}) {name}" if receiver else f"func {name}"
        self.found.functions.append((*self.place(start.at), match, name, receiver))
        if self.at("["):
            self.take()
            self.parameters("]")
        self.signature()
        if self.at("{"):
            self.body()
        self.end_of_statement()

    def receiver(self) -> str:
        """The first receiver's type as text: names, selectors and stars have one, all else has none."""
        self.expect("(")
        if self.now.kind == "name" and (self.ahead().kind == "name" or self.ahead().text in ("*", "(")):
            self.take()
        stars = ""
        while self.accept("*"):
            stars += "*"
        text = ""
        if self.now.kind == "name":
            text = utf8(self.take().text)
            while self.at("."):
                self.take()
                text += "." + utf8(self.name().text)
            if self.at("["):
                self.take()
                self.parameters("]")
                text = ""
        elif not self.at(")"):
            self.type()
        while not self.accept(")"):
            if self.now.kind == "end":
                raise GoSyntaxError("expected ')'", self.now.at)
            self.take()
        return stars + text

    # types

    def signature(self) -> None:
        self.expect("(")
        self.parameters(")")
        if self.at("("):
            self.take()
            self.parameters(")")
        elif self.starts_type():
            self.type()

    def starts_type(self, t: Token | None = None) -> bool:
        t = t or self.now
        return t.kind == "name" or t.kind in ("op", "keyword") and t.text in ("*", "[", "struct", "interface", "map", "chan", "func", "(", "<-")

    def parameters(self, close: str) -> None:
        """Names and types up to the closing bracket; which is which is of no matter but before a [."""
        while not self.accept(close):
            if self.now.kind == "name" and self.ahead().text == "[" and self._array_follows():
                self.take()  # a name, and then an array's type
            self.accept("...")
            self.constraint()
            if not self.at(",", close):
                self.accept("...")
                self.constraint()
            if not self.at(close):
                self.expect(",")

    def _array_follows(self) -> bool:
        """Whether the brackets after a name are an array's length: then an element type follows, as it can't after type arguments."""
        depth, j = 0, self.i + 1
        while self.tokens[j].kind != "end":
            t = self.tokens[j]
            if t.kind == "op":
                depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
                if not depth:
                    return self.starts_type(self.tokens[j + 1])
            j += 1
        return False

    def constraint(self) -> None:
        while True:
            self.accept("~")
            self.type()
            if not self.accept("|"):
                return

    def type(self) -> None:
        if self.now.kind == "name":
            self.take()
            if self.accept("."):
                self.name()
            if self.at("[") and not (self.ahead().text == "]"):
                self.take()
                self.parameters("]")
        elif self.accept("*"):
            self.type()
        elif self.accept("("):
            self.type()
            self.expect(")")
        elif self.accept("["):
            if not self.accept("..."):
                self.inside(lambda: None if self.at("]") else self.expression())
            self.expect("]")
            self.type()
        elif self.accept("map"):
            self.expect("[")
            self.type()
            self.expect("]")
            self.type()
        elif self.accept("chan"):
            self.accept("<-")
            self.type()
        elif self.accept("<-"):
            self.expect("chan")
            self.type()
        elif self.accept("func"):
            self.signature()
        elif self.accept("struct"):
            self.fields()
        elif self.accept("interface"):
            self.methods()
        else:
            raise GoSyntaxError(f"expected a type, found {self.now.text or 'EOF'!r}", self.now.at)

    def fields(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            if self.accept("*") or self.accept("("):
                self.accept("*")
                self.type()
                self.accept(")")
            elif self.now.kind == "name" and self.ahead().text in (".", ";", "}") or self.now.kind == "name" and self.ahead().kind == "string":
                self.type()
            elif self.now.kind == "name" and self.ahead().text == "[" and self._embedded():
                self.type()
            else:
                self.name()
                while self.accept(","):
                    self.name()
                self.type()
            if self.now.kind == "string":
                self.take()
            self.end_of_statement()

    def _embedded(self) -> bool:
        """Whether name[...] ends its field: then it is an embedded generic type, and not a name with an array's type."""
        depth, j = 0, self.i + 1
        while self.tokens[j].kind != "end":
            text = self.tokens[j].text if self.tokens[j].kind == "op" else ""
            depth += (text in "([{") - (text in ")]}") if text else 0
            if not depth:
                after = self.tokens[j + 1]
                return j > self.i + 2 and (after.text in (";", "}") or after.kind == "string")
            j += 1
        return False

    def methods(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            if self.now.kind == "name" and self.ahead().text == "(":
                self.take()
                self.signature()
            else:
                self.constraint()
            self.end_of_statement()

    # expressions

    def inside(self, read):
        """Read between brackets, where composite literals are clear."""
        level, self.level = self.level, max(0, self.level) + 1
        try:
            return read()
        finally:
            self.level = level

    def expressions(self) -> None:
        self.expression()
        while self.accept(","):
            self.expression()

    def expression(self) -> None:
        self.unary()
        while self.now.kind == "op" and self.now.text in BINARY:
            self.take()
            self.unary()

    def unary(self) -> None:
        while self.now.kind == "op" and self.now.text in UNARY:
            if self.at("<-") and self.ahead().text == "chan":
                self.type()
                return self.suffixes(self.now.at, len(self.found.calls), "", False)
            self.take()
        self.primary()

    def primary(self) -> None:
        t, mark, text, literal = self.now, len(self.found.calls), "", False
        if t.kind == "name":
            text, literal = utf8(self.take().text), True
        elif t.kind in ("number", "string", "rune"):
            self.take()
        elif self.accept("("):
            self.inside(lambda: self.expression_or_type())
            self.expect(")")
        elif self.at("func"):
            self.take()
            self.signature()
            if self.at("{"):
                self.inside(self.body)
        elif self.at("[", "struct", "map", "chan", "interface"):
            literal = not self.at("chan", "interface")
            self.type()
            if literal and self.at("{"):
                self.literal()
                literal = False
        else:
            raise GoSyntaxError(f"unexpected {t.text or 'EOF'!r}", t.at)
        self.suffixes(t.at, mark, text, literal)

    def suffixes(self, start: int, mark: int, text: str, literal: bool) -> None:
        while True:
            if self.accept("."):
                if self.accept("("):
                    if not self.accept("type"):
                        self.type()
                    self.expect(")")
                    text, literal = "", False
                else:
                    sel = utf8(self.name().text)
                    text = f"{text}.{sel}" if text else sel
            elif self.at("("):
                callee, text, literal = text, "", False
                self.take()
                end = self.inside(self.arguments)
                match = " ".join(utf8(self.source[start:end]).split())
                self.found.calls.insert(mark, (*self.place(start), match, callee))
            elif self.at("["):
                self.take()
                self.inside(self.index)
                text = ""
            elif self.at("{") and literal and self.level >= 0:
                self.literal()
                text, literal = "", False
            else:
                return

    def arguments(self) -> int:
        while not self.at(")"):
            self.expression_or_type()
            self.accept("...")
            if not self.at(")"):
                self.expect(",")
        return self.take().end

    def index(self) -> None:
        while not self.accept("]"):
            if self.accept(":", ","):
                continue
            self.expression_or_type()

    def expression_or_type(self) -> None:
        """Types read as expressions do, but for a function's type without a body, which primary() reads too."""
        self.expression()

    def literal(self) -> None:
        self.inside(self.elements)

    def elements(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            self.element()
            if self.accept(":"):
                self.element()
            if not self.at("}"):
                if self.at(";") and self.ahead().text == "}":
                    self.take()
                else:
                    self.expect(",")

    def element(self) -> None:
        if self.at("{"):
            self.elements()
        else:
            self.expression()

    # statements

    def body(self) -> None:
        level, self.level = self.level, 0
        self.expect("{")
        while not self.accept("}"):
            self.statement()
        self.level = level

    def statement(self) -> None:
        t = self.now
        if self.accept(";"):
            return
        if self.at("var", "const", "type"):
            self.declaration(top=False)
            return
        if self.at("{"):
            self.body()
        elif self.at("if"):
            self.if_statement()
        elif self.at("for"):
            self.take()
            self.head(self.for_head)
            self.body()
        elif self.at("switch"):
            self.take()
            self.head(self.clauses_head)
            self.cases()
        elif self.at("select"):
            self.take()
            self.cases()
        elif self.accept("go", "defer"):
            self.expression()
        elif self.accept("return"):
            if not self.at(";", "}"):
                self.expressions()
        elif self.accept("break", "continue", "goto", "fallthrough"):
            if self.now.kind == "name":
                self.take()
        elif t.kind == "name" and self.ahead().text == ":" and self.ahead().kind == "op":
            self.i += 2
            if not self.at("}"):
                self.statement()
            return
        else:
            self.simple()
        self.end_of_statement()

    def simple(self) -> None:
        """Expressions, assignments, sends and counts."""
        if self.at("range"):
            self.take()
            self.expression()
            return
        self.expressions()
        if self.now.kind == "op" and self.now.text in ASSIGN:
            self.take()
            self.accept("range")
            self.expressions()
        elif self.accept("<-"):
            self.expression()
        else:
            self.accept("++", "--")

    def head(self, read) -> None:
        level, self.level = self.level, -1
        read()
        self.level = level

    def clauses_head(self) -> None:
        while not self.at("{"):
            if not self.accept(";"):
                self.simple()

    for_head = clauses_head

    def if_statement(self) -> None:
        self.take()
        self.head(self.clauses_head)
        self.body()
        if self.accept("else"):
            if self.at("if"):
                self.if_statement()
            else:
                self.body()

    def cases(self) -> None:
        level, self.level = self.level, 0
        self.expect("{")
        while not self.accept("}"):
            if self.accept("default"):
                self.expect(":")
            elif self.accept("case"):
                self.simple()
                self.expect(":")
            else:
                self.statement()
        self.level = level


def parse(data: bytes) -> Parsed:
    return Parser(data).file()
