"""Span rules over scripts: which parts each of fourteen rules matches, and features of the syntax tree.

A script is parsed once, in the task that holds it, with its own time limit; scripts that don't parse have no spans and are
marked. Spans are rows (key, rule, idx, start, end, attrs), in order of place in the tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .script_syntax import SyntaxFault, children, parse

#: Functions that run or decode text, statements that keep an `if` from being matched, names with rules of their own.
RUNNERS = ["eval", "escape", "atob", "btoa", "unescape", "Function", "ActiveXObject"]
LEAVERS = ["break", "continue", "return", "yield", "throw"]
QUOTED = re.compile(r"(?:['\"]|\\)+canvas(?:['\"]|\\)+")

LITERALS, RUN, INTS, FLOATS, CLASSES, FUNCTIONS, IFS, FORS, WHILES, CALLS, MEMBERS, CALLEES, WORDS, OBJECTS = range(1, 15)


def _number(node: dict | None):
    """The value of a number literal, with a sign."""
    if node and node["type"] == "Unary" and node["operator"] == "-":
        value = _number(node["argument"])
        return None if value is None else -value
    if not node or node["type"] != "Literal" or node["kind"] != "number" or node["raw"].endswith("n"):
        return None
    raw = node["raw"].replace("_", "")
    if re.fullmatch("0[xXoObB].*", raw):
        return int(raw, 0)
    return float(raw) if re.search(r"[.eE]", raw) else int(raw)


def _kind(node: dict | None) -> str | None:
    """string, bool, int or float of a literal."""
    if node and node["type"] == "Literal" and node["kind"] in ("string", "bool"):
        return node["kind"]
    value = _number(node) if node and node["type"] == "Literal" else None
    return None if value is None else "float" if isinstance(value, float) else "int"


def argument_text(node: dict) -> str:
    """A call's argument as a literal value, a name, or a mark for anything else."""
    if node["type"] == "Literal":
        return node["raw"]
    return node["name"] if node["type"] == "Identifier" else "complex_expression"


def identifiers(node: dict | None) -> list[str]:
    """The distinct names of an expression, sorted; names of members are not among them."""
    found, todo = set(), [node] if node else []
    while todo:
        n = todo.pop()
        if n["type"] == "Identifier":
            found.add(n["name"])
        elif n["type"] == "Member" and not n["computed"]:
            todo.append(n["object"])
        else:
            todo += children(n)
    return sorted(found)


def _walk(tree: dict) -> Iterator[tuple[dict, dict | None, bool]]:
    """(node, parent, whether it is the header of a for), each once, parents first."""
    todo: list[tuple[dict, dict | None, bool]] = [(tree, None, False)]
    while todo:
        node, parent, header = todo.pop()
        yield node, parent, header
        todo += [(c, node, node["type"] in ("For", "ForIn", "ForOf") and (c is node.get("init") or c is node.get("left"))) for c in reversed(list(children(node)))]


def matches(text: str, tree: dict) -> list[tuple[int, int, int, dict[str, str]]]:
    """(rule, start, end, attrs) of all rules, in order of rule and place."""
    found: list[tuple[int, int, int, dict[str, str]]] = []

    def add(rule: int, node: dict, start: int | None = None, end: int | None = None, **attrs) -> None:
        found.append((rule, node["start"] if start is None else start, node["end"] if end is None else end, {k: str(v) for k, v in attrs.items() if v is not None}))

    refused: list[tuple[int, int]] = []
    for node, _, header in _walk(tree):
        kind = node["type"]
        if kind == "VariableDeclaration" and not header:
            for d in node["declarations"]:
                name, init = d["id"].get("name"), d["init"]
                if k := _kind(init):
                    add(LITERALS, node, name=name, kind=k, value=init["raw"])
                elif init and init["type"] == "Array" and init["elements"]:
                    kinds = {"bool" if _kind(e) == "bool" else type(_number(e)).__name__ for e in init["elements"]}
                    if kinds <= {"int", "bool"}:
                        add(INTS, node, name=name, n=len(init["elements"]))
                    elif kinds == {"float"}:
                        add(FLOATS, node, name=name, n=len(init["elements"]))
        elif kind in ("Call", "New"):
            callee = node["callee"]
            name = callee.get("name") if callee["type"] == "Identifier" else callee["property"].get("name") if callee["type"] == "Member" and not callee["computed"] else None
            owner = callee["object"].get("name") if callee["type"] == "Member" else None
            for runner in (name, owner):
                if runner in RUNNERS and kind == "Call":
                    add(RUN, node, name=runner, arguments=",".join(map(argument_text, node["arguments"])))
                    break
            if kind == "Call" and callee["type"] == "Identifier" and name == "canvas":
                add(CALLEES, node, name="canvas()")
        elif kind in ("ClassDeclaration", "ClassExpression"):
            add(CLASSES, node, name=node["name"])
        elif kind in ("FunctionDeclaration", "FunctionExpression", "Arrow"):
            add(FUNCTIONS, node, name=node.get("name"))
        elif kind == "Method":  # a function expression from its parameters on
            add(FUNCTIONS, node, start=text.index("(", node["key"]["end"]))
        elif kind == "If":
            # What is inside a refused `if` is not matched either.
            if not any(s <= node["start"] and node["end"] <= e for s, e in refused):
                parts = [p for p in (node["consequent"], node["alternate"]) if p]
                if any(w in text[p["start"] : p["end"]] for p in parts for w in LEAVERS):
                    refused.append((node["start"], node["end"]))
                else:
                    add(IFS, node)
        elif kind == "For":
            init = node["init"]
            if init and init["type"] == "VariableDeclaration" and len(init["declarations"]) == 1:
                add(FORS, node, name=init["declarations"][0]["id"].get("name"))
        elif kind == "While":
            add(WHILES, node, names=",".join(identifiers(node["test"])))
        elif kind == "ExpressionStatement" and node["expression"]["type"] == "Call" and node["start"] > 0:
            add(CALLS, node["expression"], end=node["expression"]["end"] + 1)
        elif kind == "Member":
            p = node["property"]
            name = p.get("name") if not node["computed"] else p["raw"][1:-1] if p["type"] == "Literal" and p["kind"] == "string" else None
            if name:
                at = text.find(name, node["start"], node["end"])
                if at >= 0:
                    add(MEMBERS, node, start=at, end=at + len(name), name=name, access="[]" if node["computed"] else ".")
            owner = node["object"].get("name")
            if owner == "screen":
                add(CALLEES, node, name=owner)
            if owner in ("screen", "canvas"):
                add(OBJECTS, node, end=node["start"] + 6, name=owner)
    for m in QUOTED.finditer(text):
        if not re.compile(r"\s*:").match(text, m.end()):
            found.append((WORDS, m.start(), m.end(), {}))
    return sorted(found, key=lambda x: x[0])


_ESTREE = {"FunctionDeclaration": "FunctionDeclaration", "FunctionExpression": "FunctionExpression", "Arrow": "ArrowFunctionExpression", "Declarator": "VariableDeclarator", "Member": "MemberExpression", "Call": "CallExpression", "New": "NewExpression", "Binary": "BinaryExpression", "Assignment": "AssignmentExpression", "If": "IfStatement", "For": "ForStatement", "While": "WhileStatement", "Return": "ReturnStatement", "Property": "Property", "Array": "ArrayExpression", "Unary": "UnaryExpression", "Update": "UpdateExpression", "Conditional": "ConditionalExpression"}


def features(tree: dict) -> list[str]:
    """`Parent:name` of every name and literal with a parent, by the tree's usual type names."""
    out = []
    for node, parent, _ in _walk(tree):
        if parent and node["type"] in ("Identifier", "Literal"):
            value = node.get("name", node.get("raw", ""))
            if node["type"] == "Literal" and node["kind"] == "string":
                value = value[1:-1]
            out.append(f"{_ESTREE.get(parent['type'], parent['type'])}:{value}")
    return out


def statement_features(tree: dict) -> list[str]:
    """Features of the top level alone: tests of its `if`s, and of those in their branches."""

    def words(node: dict) -> str:
        if node["type"] == "Identifier":
            return f"Identifier: {node['name']}"
        return f"Literal: {node['raw']}" if node["type"] == "Literal" else "Unknown Statement"

    out, todo = [], list(reversed(tree["body"]))
    while todo:
        node = todo.pop()
        if node["type"] in ("Identifier", "Literal"):
            out.append(words(node))
        elif node["type"] == "If":
            out.append(f"If: {words(node['test'])}")
            todo += [n for n in (node["alternate"], node["consequent"]) if n]
    return out


_SPANS = pa.schema([("key", pa.string()), ("rule", pa.int32()), ("idx", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string()))])


def _mapped(scripts: DataFrame, key: str, column: str, schema: pa.Schema, ddl: str, rows) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [r for k, text in zip(*(c.to_pylist() for c in batch.columns)) for r in rows(k, text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return scripts.select(F.col(key).cast("string"), column).mapInArrow(run, ddl)


def match_rules(scripts: DataFrame, key: str = "key", column: str = "script", seconds: float = 10.0) -> DataFrame:
    """The spans of all rules in each script that parses."""

    def rows(k, text):
        try:
            found = matches(text, parse(text, seconds))
        except SyntaxFault:
            return
        count: dict[int, int] = {}
        for rule, start, end, attrs in found:
            idx = count[rule] = count.get(rule, -1) + 1
            yield k, rule, idx, start, end, list(attrs.items())

    return _mapped(scripts, key, column, _SPANS, "key string, rule int, idx int, start int, end int, attrs map<string,string>", rows)


def parse_checks(scripts: DataFrame, key: str = "key", column: str = "script", seconds: float = 10.0) -> DataFrame:
    """key, parsed: whether a script parses within the time."""

    def rows(k, text):
        try:
            parse(text, seconds)
            yield k, True
        except SyntaxFault:
            yield k, False

    return _mapped(scripts, key, column, pa.schema([("key", pa.string()), ("parsed", pa.bool_())]), "key string, parsed boolean", rows)


def tree_features(scripts: DataFrame, key: str = "key", column: str = "script", top_level: bool = False) -> DataFrame:
    """key, features of each script; none for those that don't parse."""
    schema = pa.schema([("key", pa.string()), ("features", pa.list_(pa.string()))])

    def rows(k, text):
        try:
            tree = parse(text)
            yield k, statement_features(tree) if top_level else features(tree)
        except SyntaxFault:
            yield k, []

    return _mapped(scripts, key, column, schema, "key string, features array<string>", rows)
