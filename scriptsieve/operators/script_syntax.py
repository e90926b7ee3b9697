"""A lexer and parser for scripts, as far as the span rules need: statements, functions, classes and expressions with offsets.

Nodes are dicts with `type`, `start`, `end` and children; offsets count characters. Scripts that don't parse raise SyntaxFault."""

from __future__ import annotations

import re
import sys
import time


class SyntaxFault(ValueError):
    pass


_SPACE = re.compile(r"(?:\s+|//[^\n\r  ]*|/\*.*?\*/|<!--[^\n]*)+", re.S)
_TOKEN = re.compile(
    r"""(?P<number>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?n?)
|(?P<name>\#?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)
|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
|(?P<mark>>>>=|\.\.\.|===|!==|>>>|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*")
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_UNARY = {"!", "~", "+", "-", "typeof", "void", "delete", "await"}
_RESERVED = {"break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "export", "extends", "finally", "for", "function", "if", "import", "in", "instanceof", "new", "return", "super", "switch", "this", "throw", "try", "typeof", "var", "void", "while", "with"}


class Parser:
    def __init__(self, text: str, seconds: float = 10.0):
        self.text, self.at, self.deadline = text, 0, time.monotonic() + seconds
        self.kind, self.value, self.start, self.end, self.fresh = "", "", 0, 0, False
        self.last_end = 0
        self.no_in = False
        self.advance()

    # ---- tokens

    def advance(self) -> None:
        self.last_end = self.end
        m = _SPACE.match(self.text, self.at)
        gap = m.group() if m else ""
        self.fresh = "\n" in gap or "\r" in gap
        self.start = self.at + len(gap)
        if self.start >= len(self.text):
            self.kind, self.value, self.end, self.at = "eof", "", self.start, self.start
            return
        if self.text[self.start] == "`":
            self.kind, self.value, self.end = "template", "`", self.start + 1
        else:
            m = _TOKEN.match(self.text, self.start)
            if not m:
                raise SyntaxFault(f"unexpected character at {self.start}")
            self.kind, self.value, self.end = m.lastgroup, m.group(), m.end()
        self.at = self.end
        if time.monotonic() > self.deadline:
            raise SyntaxFault("out of time")

    def back(self, state) -> None:
        self.at, self.kind, self.value, self.start, self.end, self.fresh, self.last_end, self.no_in = state

    def state(self):
        return self.at, self.kind, self.value, self.start, self.end, self.fresh, self.last_end, self.no_in

    def sees(self, *values: str) -> bool:
        return self.kind in ("mark", "name") and self.value in values

    def takes(self, value: str) -> bool:
        if self.sees(value):
            self.advance()
            return True
        return False

    def needs(self, value: str) -> None:
        if not self.takes(value):
            raise SyntaxFault(f"{value} expected at {self.start}")

    def ended(self) -> None:
        if not self.takes(";") and not (self.sees("}") or self.kind == "eof" or self.fresh):
            raise SyntaxFault(f"; expected at {self.start}")

    def node(self, type_: str, start: int, **fields) -> dict:
        return {"type": type_, "start": start, "end": self.last_end, **fields}

    # ---- statements

    def program(self) -> dict:
        body = []
        while self.kind != "eof":
            body.append(self.statement())
        return {"type": "Program", "start": 0, "end": len(self.text), "body": body}

    def block(self) -> dict:
        start = self.start
        self.needs("{")
        body = []
        while not self.sees("}"):
            if self.kind == "eof":
                raise SyntaxFault("} expected")
            body.append(self.statement())
        self.advance()
        return self.node("Block", start, body=body)

    def statement(self) -> dict:
        start = self.start
        if self.kind == "mark" and self.value in "{;":
            if self.value == "{":
                return self.block()
            self.advance()
            return self.node("Empty", start)
        if self.kind == "name":
            method = getattr(self, f"_{self.value}", None) if self.value in _STATEMENTS else None
            if self.value == "let" or self.value == "async":
                s, word = self.state(), self.value
                self.advance()
                ok = (self.kind == "name" and self.value not in ("in", "instanceof", "of") or self.sees("[", "{")) if word == "let" else self.sees("function") and not self.fresh
                self.back(s)
                method = (self._var if word == "let" else self._function) if ok else None
            if method:
                return method(start)
            s = self.state()
            if self.value not in _RESERVED:
                self.advance()
                if self.takes(":"):
                    return self.node("Labeled", start, body=self.statement())
                self.back(s)
        e = self.expression()
        self.ended()
        return self.node("ExpressionStatement", start, expression=e)

    def _var(self, start, header: bool = False) -> dict:
        kind = self.value
        self.advance()
        found = []
        while True:
            s = self.start
            target = self.primary_pattern()
            init = self.assignment() if self.takes("=") else None
            found.append(self.node("Declarator", s, id=target, init=init))
            if not self.takes(","):
                break
        out = self.node("VariableDeclaration", start, kind=kind, declarations=found)
        if not header:
            self.ended()
            out["end"] = self.last_end
        return out

    _const = _var

    def primary_pattern(self) -> dict:
        if self.kind == "name" and self.value not in _RESERVED:
            s, v = self.start, self.value
            self.advance()
            return self.node("Identifier", s, name=v)
        if self.sees("[", "{"):
            return self.primary()
        raise SyntaxFault(f"name expected at {self.start}")

    def _function(self, start) -> dict:
        if self.value == "async":
            self.advance()
        self.advance()
        self.takes("*")
        name = None
        if self.kind == "name" and not self.sees("("):
            name = self.value
            self.advance()
        params = self.parameters()
        return self.node("FunctionDeclaration", start, name=name, params=params, body=self.block()) | {"end": self.last_end}

    def parameters(self) -> list[dict]:
        self.needs("(")
        out = []
        while not self.takes(")"):
            self.takes("...")
            p = self.primary_pattern()
            if self.takes("="):
                p = self.node("Default", p["start"], left=p, right=self.assignment())
            out.append(p)
            if not self.sees(")"):
                self.needs(",")
        return out

    def _class(self, start, type_: str = "ClassDeclaration") -> dict:
        self.advance()
        name = None
        if self.kind == "name" and self.value != "extends":
            name = self.value
            self.advance()
        parent = self.unary() if self.takes("extends") else None
        self.needs("{")
        body = []
        while not self.takes("}"):
            if not self.takes(";"):
                body.append(self.member(True))
        return self.node(type_, start, name=name, parent=parent, body=body)

    def member(self, in_class: bool) -> dict:
        """A property or method of an object or class."""
        start = self.start
        if self.takes("..."):
            return self.node("Spread", start, argument=self.assignment()) | {"end": self.last_end}
        for word in ("static", "async", "get", "set"):
            if self.sees(word):
                s = self.state()
                self.advance()
                if self.sees("(", ",", "}", ":", "=", ";"):
                    self.back(s)
                    break
        self.takes("*")
        if in_class and self.sees("{"):
            return self.block()
        key = self.key()
        if self.sees("("):
            params = self.parameters()
            body = self.block()
            return self.node("Method", start, key=key, params=params, body=body)
        if not in_class and self.takes(":"):
            value = self.assignment()
            return self.node("Property", start, key=key, value=value)
        value = self.assignment() if self.takes("=") else None
        if in_class:
            self.ended()
            return self.node("Field", start, key=key, value=value)
        return self.node("Property", start, key=key, value=value or key, short=True)

    def key(self) -> dict:
        s, v = self.start, self.value
        if self.takes("["):
            e = self.assignment()
            self.needs("]")
            return self.node("Computed", s, expression=e)
        if self.kind in ("name", "string", "number"):
            kind = self.kind
            self.advance()
            return self.node("Identifier", s, name=v) if kind == "name" else self.node("Literal", s, kind=kind, raw=v)
        raise SyntaxFault(f"key expected at {s}")

    def _if(self, start) -> dict:
        self.advance()
        test = self.paren()
        yes = self.statement()
        no = self.statement() if self.takes("else") else None
        return self.node("If", start, test=test, consequent=yes, alternate=no)

    def paren(self) -> dict:
        self.needs("(")
        e = self.expression()
        self.needs(")")
        return e

    def _for(self, start) -> dict:
        self.advance()
        self.takes("await")
        self.needs("(")
        init = None
        if not self.sees(";"):
            self.no_in = True
            init = self._var(self.start, True) if self.sees("var", "let", "const") else self.expression()
            self.no_in = False
        if self.sees("in", "of"):
            type_ = "ForIn" if self.value == "in" else "ForOf"
            self.advance()
            right = self.expression()
            self.needs(")")
            return self.node(type_, start, left=init, right=right, body=self.statement()) | {"end": self.last_end}
        self.needs(";")
        test = None if self.sees(";") else self.expression()
        self.needs(";")
        update = None if self.sees(")") else self.expression()
        self.needs(")")
        body = self.statement()
        return self.node("For", start, init=init, test=test, update=update, body=body)

    def _while(self, start) -> dict:
        self.advance()
        test = self.paren()
        body = self.statement()
        return self.node("While", start, test=test, body=body)

    def _do(self, start) -> dict:
        self.advance()
        body = self.statement()
        self.needs("while")
        test = self.paren()
        self.takes(";")
        return self.node("DoWhile", start, test=test, body=body)

    def _return(self, start) -> dict:
        word = self.value
        self.advance()
        e = None if self.sees(";", "}") or self.kind == "eof" or self.fresh else self.expression()
        self.ended()
        return self.node(word.capitalize(), start, argument=e)

    _throw = _return

    def _break(self, start) -> dict:
        word = self.value
        self.advance()
        if self.kind == "name" and not self.fresh:
            self.advance()
        self.ended()
        return self.node(word.capitalize(), start)

    _continue = _debugger = _break

    def _try(self, start) -> dict:
        self.advance()
        body, handler, last = self.block(), None, None
        if self.takes("catch"):
            if self.takes("("):
                self.primary_pattern()
                self.needs(")")
            handler = self.block()
        if self.takes("finally"):
            last = self.block()
        if handler is None and last is None:
            raise SyntaxFault(f"catch expected at {self.start}")
        return self.node("Try", start, body=body, handler=handler, last=last)

    def _switch(self, start) -> dict:
        self.advance()
        test = self.paren()
        self.needs("{")
        cases = []
        while not self.takes("}"):
            s = self.start
            value = None
            if self.takes("case"):
                value = self.expression()
            else:
                self.needs("default")
            self.needs(":")
            body = []
            while not self.sees("case", "default", "}"):
                body.append(self.statement())
            cases.append(self.node("Case", s, test=value, body=body))
        return self.node("Switch", start, test=test, cases=cases)

    def _with(self, start) -> dict:
        self.advance()
        test = self.paren()
        return self.node("With", start, test=test, body=self.statement()) | {"end": self.last_end}

    # ---- expressions

    def expression(self) -> dict:
        start = self.start
        e = self.assignment()
        if not self.sees(","):
            return e
        found = [e]
        while self.takes(","):
            found.append(self.assignment())
        return self.node("Sequence", start, expressions=found)

    def arrow(self) -> dict | None:
        s, start = self.state(), self.start
        try:
            if self.sees("async"):
                self.advance()
                if self.fresh or not (self.sees("(") or self.kind == "name"):
                    raise SyntaxFault("")
            if self.kind == "name" and self.value not in _RESERVED:
                params = [self.primary_pattern()]
            else:
                params = self.parameters()
            if self.fresh or not self.takes("=>"):
                raise SyntaxFault("")
        except SyntaxFault:
            self.back(s)
            return None
        held, self.no_in = self.no_in, False
        body = self.block() if self.sees("{") else self.assignment()
        self.no_in = held
        return self.node("Arrow", start, params=params, body=body)

    def assignment(self) -> dict:
        start = self.start
        if self.sees("(", "async") or self.kind == "name" and self.value not in _RESERVED:
            if (a := self.arrow()) is not None:
                return a
        if self.takes("yield"):
            self.takes("*")
            e = None if self.sees(")", "]", "}", ",", ";") or self.fresh or self.kind == "eof" else self.assignment()
            return self.node("Yield", start, argument=e)
        left = self.conditional()
        if self.kind == "mark" and self.value in _ASSIGN:
            op = self.value
            self.advance()
            right = self.assignment()
            return self.node("Assignment", start, operator=op, left=left, right=right)
        return left

    def conditional(self) -> dict:
        start = self.start
        test = self.binary(0)
        if not self.takes("?"):
            return test
        held, self.no_in = self.no_in, False
        yes = self.assignment()
        self.no_in = held
        self.needs(":")
        no = self.assignment()
        return self.node("Conditional", start, test=test, consequent=yes, alternate=no)

    def binary(self, least: int) -> dict:
        start = self.start
        left = self.unary()
        while self.kind in ("mark", "name") and (p := _BINARY.get(self.value, 0)) > least and not (self.no_in and self.value == "in"):
            op = self.value
            self.advance()
            right = self.binary(p - 1 if op == "**" else p)
            left = self.node("Binary", start, operator=op, left=left, right=right)
        return left

    def unary(self) -> dict:
        start = self.start
        if self.kind in ("mark", "name") and (self.value in _UNARY or self.value in ("++", "--")):
            op = self.value
            self.advance()
            return self.node("Unary", start, operator=op, argument=self.unary()) | {"end": self.last_end}
        e = self.postfix(self.primary(), start)
        if self.sees("++", "--") and not self.fresh:
            self.advance()
            return self.node("Update", start, argument=e)
        return e

    def postfix(self, e: dict, start: int, calls: bool = True) -> dict:
        while True:
            if self.takes("?."):
                if not self.sees("(", "["):
                    e = self.node("Member", start, object=e, property=self.key(), computed=False) | {"end": self.last_end}
                    continue
            if self.takes("."):
                if self.kind != "name":
                    raise SyntaxFault(f"name expected at {self.start}")
                e = self.node("Member", start, object=e, property=self.key(), computed=False) | {"end": self.last_end}
            elif self.sees("["):
                self.advance()
                held, self.no_in = self.no_in, False
                p = self.expression()
                self.no_in = held
                self.needs("]")
                e = self.node("Member", start, object=e, property=p, computed=True)
            elif calls and self.sees("("):
                e = self.node("Call", start, callee=e, arguments=self.arguments()) | {"end": self.last_end}
            elif self.kind == "template":
                e = self.node("Tagged", start, tag=e, quasi=self.template()) | {"end": self.last_end}
            else:
                return e

    def arguments(self) -> list[dict]:
        self.needs("(")
        held, self.no_in = self.no_in, False
        out = []
        while not self.takes(")"):
            s = self.start
            out.append(self.node("Spread", s, argument=self.assignment()) if self.takes("...") else self.assignment())
            if not self.sees(")"):
                self.needs(",")
        self.no_in = held
        return out

    def template(self) -> dict:
        start, at, parts = self.start, self.start + 1, []
        while True:
            if at >= len(self.text):
                raise SyntaxFault("unclosed template")
            c = self.text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                break
            elif self.text.startswith("${", at):
                self.at = at + 2
                self.advance()
                parts.append(self.expression())
                if not self.sees("}"):
                    raise SyntaxFault(f"}} expected at {self.start}")
                at = self.end
            else:
                at += 1
        self.end = self.at = at + 1
        self.advance()
        return self.node("Template", start, expressions=parts)

    def primary(self) -> dict:
        start, value, kind = self.start, self.value, self.kind
        if kind == "template":
            return self.template()
        if kind in ("number", "string"):
            self.advance()
            return self.node("Literal", start, kind=kind, raw=value)
        if kind == "mark" and value in ("/", "/="):
            m = _REGEX.match(self.text, start)
            if not m:
                raise SyntaxFault(f"unexpected / at {start}")
            self.end = self.at = m.end()
            self.advance()
            return self.node("Literal", start, kind="regex", raw=m.group())
        if kind == "mark" and value == "(":
            held, self.no_in = self.no_in, False
            e = self.paren()
            self.no_in = held
            return e
        if kind == "mark" and value == "[":
            self.advance()
            held, self.no_in = self.no_in, False
            found: list[dict | None] = []
            while not self.takes("]"):
                if self.takes(","):
                    found.append(None)
                    continue
                s = self.start
                found.append(self.node("Spread", s, argument=self.assignment()) if self.takes("...") else self.assignment())
                if not self.sees("]"):
                    self.needs(",")
            self.no_in = held
            return self.node("Array", start, elements=found)
        if kind == "mark" and value == "{":
            self.advance()
            held, self.no_in = self.no_in, False
            found = []
            while not self.takes("}"):
                found.append(self.member(False))
                if not self.sees("}"):
                    self.needs(",")
            self.no_in = held
            return self.node("Object", start, members=found)
        if kind == "name":
            if value == "function" or value == "async" and re.compile(r"async[ \t]+function\b").match(self.text, start):
                return self._function(start) | {"type": "FunctionExpression"}
            if value == "class":
                return self._class(start, "ClassExpression")
            if value == "new":
                self.advance()
                if self.takes("."):
                    self.advance()
                    return self.node("Identifier", start, name="new.target")
                callee = self.postfix(self.primary(), self.start, calls=False)
                given = self.arguments() if self.sees("(") else []
                return self.node("New", start, callee=callee, arguments=given)
            if value in ("true", "false", "null"):
                self.advance()
                return self.node("Literal", start, kind="bool" if value != "null" else "null", raw=value)
            if value in ("this", "super", "import") or value not in _RESERVED:
                self.advance()
                return self.node("Identifier", start, name=value)
        raise SyntaxFault(f"unexpected {value or 'end'} at {start}")


_STATEMENTS = {"var", "const", "function", "class", "if", "for", "while", "do", "return", "throw", "break", "continue", "debugger", "try", "switch", "with"}


#: Frames of the parser at most, which bounds its memory to some 300 MB; a level of nesting takes up to sixteen.
FRAMES = 400_000


def parse(text: str, seconds: float = 10.0) -> dict:
    """The tree of a script. The parser's frames are on the heap, so the limit is that of memory: 25,000 nested functions and more."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, min(FRAMES, 2_000 + 16 * len(text))))
    try:
        return Parser(text, seconds).program()
    except RecursionError as e:
        raise SyntaxFault("nested too deeply") from e
    finally:
        sys.setrecursionlimit(before)


def children(node: dict):
    for v in node.values():
        if isinstance(v, dict):
            yield v
        elif isinstance(v, list):
            yield from (x for x in v if isinstance(x, dict))
