"""GraphQL documents: operations, fields, arguments, variables, fragments, directives."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from larkspur.errors import bad_request

TOKEN = re.compile(r'[\s,﻿]*(?:#[^\n]*[\s,]*)*("""(?:.|\n)*?"""|"(?:[^"\\\n]|\\.)*"|\.\.\.|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[_A-Za-z]\w*|[{}()\[\]:=!|@&$])')


@dataclass(frozen=True)
class Var:
    name: str


@dataclass
class FieldNode:
    name: str
    alias: str | None = None
    args: dict[str, Any] = field(default_factory=dict)
    fields: list["FieldNode"] = field(default_factory=list)

    @property
    def key(self) -> str:
        return self.alias or self.name


@dataclass
class Operation:
    kind: str
    name: str | None
    defaults: dict[str, Any]
    required: set[str]
    selection: list


class Parser:
    def __init__(self, text: str):
        self.tokens: list[str] = []
        at = 0
        while m := TOKEN.match(text, at):
            self.tokens.append(m[1])
            at = m.end()
        if re.sub(r"(#[^\n]*)|[\s,]", "", text[at:]):
            raise bad_request(f"GraphQL syntax error near {text[at : at + 20]!r}")
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or (want is not None and t != want):
            raise bad_request(f"GraphQL syntax error: expected {want or 'more'}, found {t or 'the end'}")
        self.at += 1
        return t

    def name(self) -> str:
        t = self.take()
        if not re.fullmatch(r"[_A-Za-z]\w*", t):
            raise bad_request(f"GraphQL syntax error: {t!r} is not a name")
        return t

    def document(self) -> tuple[list[Operation], dict[str, list]]:
        ops, fragments = [], {}
        while self.peek():
            if self.peek() == "{":
                ops.append(Operation("query", None, {}, set(), self.selection()))
                continue
            word = self.name()
            if word == "fragment":
                name = self.name()
                self.take("on")
                self.name()
                fragments[name] = self.selection()
                continue
            if word not in ("query", "mutation", "subscription"):
                raise bad_request(f"GraphQL syntax error: {word!r}")
            name = self.name() if self.peek() not in ("{", "(", "@") else None
            defaults, required = self.variables()
            while self.peek() == "@":
                self.directive()
            ops.append(Operation(word, name, defaults, required, self.selection()))
        return ops, fragments

    def variables(self) -> tuple[dict[str, Any], set[str]]:
        defaults: dict[str, Any] = {}
        required: set[str] = set()
        if self.peek() == "(":
            self.take()
            while self.peek() != ")":
                self.take("$")
                name = self.name()
                self.take(":")
                bang = False
                while self.peek() in ("[", "]", "!") or re.fullmatch(r"\w+", self.peek() or " "):
                    bang = self.take() == "!"
                if self.peek() == "=":
                    self.take()
                    defaults[name] = self.value()
                elif bang:
                    required.add(name)
            self.take(")")
        return defaults, required

    def directive(self) -> tuple[str, dict]:
        self.take("@")
        return self.name(), self.arguments()

    def arguments(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        if self.peek() == "(":
            self.take()
            while self.peek() != ")":
                name = self.name()
                self.take(":")
                out[name] = self.value()
            self.take(")")
        return out

    def selection(self) -> list:
        """FieldNodes, ('spread', name, directives) and ('inline', selection, directives)."""
        self.take("{")
        out: list = []
        while self.peek() != "}":
            if self.peek() == "...":
                self.take()
                if self.peek() in ("on", "{", "@"):
                    if self.peek() == "on":
                        self.take()
                        self.name()
                    ds = self.directives()
                    out.append(("inline", self.selection(), ds))
                else:
                    name = self.name()
                    out.append(("spread", name, self.directives()))
                continue
            name, alias = self.name(), None
            if self.peek() == ":":
                self.take()
                alias, name = name, self.name()
            node = FieldNode(name, alias, self.arguments())
            ds = self.directives()
            sub = self.selection() if self.peek() == "{" else []
            out.append(("field", (node, sub), ds))
        self.take("}")
        return out

    def directives(self) -> list[tuple[str, dict]]:
        out = []
        while self.peek() == "@":
            out.append(self.directive())
        return out

    def value(self) -> Any:
        t = self.take()
        if t == "$":
            return Var(self.name())
        if t == "[":
            items = []
            while self.peek() != "]":
                items.append(self.value())
            self.take("]")
            return items
        if t == "{":
            obj = {}
            while self.peek() != "}":
                key = self.name()
                self.take(":")
                obj[key] = self.value()
            self.take("}")
            return obj
        if t.startswith('"""'):
            return t[3:-3].strip("\n")
        if t.startswith('"'):
            return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(m[1], m[1]), t[1:-1])
        if t in ("true", "false"):
            return t == "true"
        if t == "null":
            return None
        if re.fullmatch(r"-?\d+", t):
            return int(t)
        if re.match(r"-?\d", t):
            return float(t)
        if re.fullmatch(r"\w+", t):
            return t
        raise bad_request(f"GraphQL syntax error: {t!r} is not a value")


def parse(text: str, variables: dict[str, Any], operation: str | None = None) -> tuple[str, list[FieldNode]]:
    """The kind of the chosen operation and its fields, with variables, fragments and directives worked in."""
    ops, fragments = Parser(text).document()
    if operation is not None:
        ops = [o for o in ops if o.name == operation]
    if len(ops) != 1:
        raise bad_request("the document must have one operation, or name the one to run")
    op = ops[0]
    values = op.defaults | variables
    if missing := sorted(op.required - {k for k, v in values.items() if v is not None}):
        raise bad_request(f"variables are missing: {', '.join(missing)}")

    def fill(v: Any) -> Any:
        if isinstance(v, Var):
            return values.get(v.name)
        if isinstance(v, list):
            return [fill(x) for x in v]
        return {k: fill(x) for k, x in v.items()} if isinstance(v, dict) else v

    def wanted(ds: list[tuple[str, dict]]) -> bool:
        return all(fill(a.get("if")) is (n == "include") for n, a in ds if n in ("include", "skip"))

    def fields(selection: list, seen: tuple[str, ...] = ()) -> list[FieldNode]:
        out: list[FieldNode] = []
        for kind, what, ds in selection:
            if not wanted(ds):
                continue
            if kind == "field":
                node, sub = what
                new = FieldNode(node.name, node.alias, {k: fill(v) for k, v in node.args.items()}, fields(sub, seen))
                same = next((f for f in out if f.key == new.key), None)
                if same:
                    same.fields += [f for f in new.fields if f.key not in {g.key for g in same.fields}]
                else:
                    out.append(new)
            elif kind == "inline":
                out += fields(what, seen)
            else:
                if what not in fragments or what in seen:
                    raise bad_request(f"fragment {what} is unknown or refers to itself")
                out += fields(fragments[what], (*seen, what))
        return out

    return op.kind, fields(op.selection)
