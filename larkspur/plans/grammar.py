"""The query dialect: `select`, filters, `and`/`or`, `order`, paging. A recursive-descent reader; leftovers are errors."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from urllib.parse import unquote

from larkspur.errors import bad_request
from larkspur.plans.ir import Aggregate, Below, Embed, Everything, Field, Filter, Item, Logic, Order, Pick, Read, Tree

AGGREGATES = frozenset("sum avg max min count".split())
COMPARE = frozenset("eq neq gt gte lt lte like ilike match imatch isdistinct".split())
SETS = frozenset("cs cd ov sl sr nxr nxl adj".split())
FTS = frozenset("fts plfts phfts wfts".split())
OPS = COMPARE | SETS | FTS | {"in", "is"}
QUANTIFIED = frozenset("eq like ilike gt gte lt lte match imatch".split())
RESERVED = frozenset("select order limit offset columns on_conflict and or not.and not.or having distinct".split())
NAME = re.compile(r"[^\W\d][\w$ ]*|\"(?:[^\"\\]|\\.)*\"")


class Reader:
    """A cursor over text."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, want: str):
        raise bad_request(f"expected {want} at position {self.at} of {self.text!r}")

    def ended(self) -> bool:
        return self.at >= len(self.text)

    def looks(self, start: str) -> bool:
        return self.text.startswith(start, self.at)

    def take(self, start: str) -> bool:
        if self.looks(start):
            self.at += len(start)
            return True
        return False

    def need(self, start: str) -> None:
        if not self.take(start):
            self.fail(repr(start))

    def match(self, pattern: str | re.Pattern) -> str | None:
        m = (pattern if isinstance(pattern, re.Pattern) else re.compile(pattern)).match(self.text, self.at)
        if m:
            self.at = m.end()
            return m[0]
        return None

    def name(self) -> str:
        got = self.match(NAME)
        if got is None:
            self.fail("a name")
        return re.sub(r"\\(.)", r"\1", got[1:-1]) if got.startswith('"') else got.strip()

    def field(self) -> Field:
        name, path = self.name(), []
        while self.looks("->"):
            op = "->>" if self.take("->>") else "->"
            if op == "->":
                self.need("->")
            key = self.match(r"-?\d+(?![\w])")
            path.append((op, int(key) if key is not None else self.name()))
        return Field(name, tuple(path))

    def cast(self) -> str | None:
        if self.take("::"):
            got = self.match(r"\w[\w ]*(?:\(\d+(?:,\s*\d+)?\))?(?:\[\])?")
            return got.strip() if got else self.fail("a type")
        return None

    def alias(self) -> str | None:
        return self.name() if self.looks(":") and not self.looks("::") and self.take(":") else None


def parse_select(text: str) -> tuple[Item, ...]:
    r = Reader(text)
    items = _items(r) if text.strip() else ()
    if not r.ended():
        r.fail("the end or ','")
    return items


def _items(r: Reader) -> tuple[Item, ...]:
    out = [_item(r)]
    while r.take(","):
        out.append(_item(r))
    return tuple(out)


def _item(r: Reader) -> Item:
    if r.take("*"):
        return Everything()
    spread = r.take("...")
    field = r.field()
    if not spread and field.name in AGGREGATES and not field.path and r.looks("("):
        r.take("(")
        of = None if r.looks(")") else r.field()
        r.need(")")
        if of is None and field.name != "count":
            r.fail("a column")
        cast = r.cast()
        return Aggregate(field.name, of, cast, r.alias())
    hints: list[str] = []
    alias = None
    while r.take("!"):
        hints.append(r.name())
    if not field.path and not r.looks("::"):
        alias = r.alias()
        while r.take("!"):
            hints.append(r.name())
    if r.take("("):
        items = () if r.looks(")") else _items(r)
        r.need(")")
        hint = next((h for h in hints if h not in ("inner", "left")), None)
        return Embed(field.name, items or (Everything(),), alias, hint, "inner" in hints, spread)
    if spread:
        return Embed(field.name, (Everything(),), alias, next((h for h in hints if h not in ("inner", "left")), None), "inner" in hints, True)
    if hints:
        r.fail("'('")
    cast = r.cast()
    return Pick(field, cast, alias or r.alias())


def parse_key(text: str) -> Field:
    r = Reader(text)
    field = r.field()
    if not r.ended():
        r.fail("the end of a column name")
    return field


def parse_filter(field: Field, text: str) -> Filter:
    """[not.]op[(any|all|language)].value"""
    negated = False
    while text.startswith("not."):
        negated, text = not negated, text[4:]
    m = re.match(r"(\w+)(?:\((\w+)\))?\.", text)
    if not m or m[1] not in OPS:
        raise bad_request(f"unknown operator in filter on {field.name}: {text!r}")
    op, extra, value = m[1], m[2], text[m.end() :]
    quantifier = language = None
    if extra:
        if op in FTS:
            language = extra
        elif extra in ("any", "all") and op in QUANTIFIED:
            quantifier = extra
        else:
            raise bad_request(f"operator {op} takes no ({extra})")
    if op == "is" and value.lower() not in ("null", "true", "false", "unknown", "not_null"):
        raise bad_request(f"is takes null, true, false or unknown, not {value!r}")
    if op == "in":
        return Filter(field, op, parse_list(value), negated)
    return Filter(field, op, value.lower() if op == "is" else value, negated, quantifier, language)


def parse_list(text: str) -> list[str]:
    """(a,b,"c,d"): trimmed items; quotes keep commas."""
    if not (text.startswith("(") and text.endswith(")")):
        raise bad_request(f"in takes a list in parentheses, not {text!r}")
    return [_unquote(x) for x in _split(text[1:-1])] if text[1:-1].strip() else []


def _unquote(x: str) -> str:
    x = x.strip()
    return re.sub(r"\\(.)", r"\1", x[1:-1]) if len(x) > 1 and x[0] == x[-1] == '"' else x


def _split(text: str) -> list[str]:
    """At commas outside quotes, parentheses, brackets and braces. A range's '[1,5)' is one item."""
    out, depth, quoted, start, i = [], 0, False, 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and quoted:
            i += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == "," and depth == 0:
                out.append(text[start:i])
                start = i + 1
        i += 1
    if quoted or depth:
        raise bad_request(f"unbalanced quotes or parentheses in {text!r}")
    return [*out, text[start:]]


def parse_logic(op: str, text: str, negated: bool = False) -> Logic:
    """(a.eq.1,or(b.gt.2,not.and(...)))"""
    text = text.strip()
    if not (text.startswith("(") and text.endswith(")")):
        raise bad_request(f"{op} takes conditions in parentheses, not {text!r}")
    children: list[Tree] = []
    for part in _split(text[1:-1]):
        part = part.strip()
        m = re.match(r"((?:not\.)*)(and|or)(?=\()", part)
        if m:
            children.append(parse_logic(m[2], part[m.end() :], m[1].count("not.") % 2 == 1))
        else:
            children.append(_condition(part))
    return Logic(op, tuple(children), negated)


def _condition(text: str) -> Filter:
    m = re.match(r"((?:\"[^\"]*\"|[^.\"])+)\.(.*)\Z", text, re.S)
    if not m:
        raise bad_request(f"not a condition: {text!r}")
    f = parse_filter(parse_key(m[1]), m[2])
    return replace(f, value=_unquote(f.value)) if isinstance(f.value, str) and f.value.startswith('"') else f


def parse_order(text: str) -> tuple[Order, ...]:
    """col[.asc|.desc][.nullsfirst|.nullslast], rel(col).desc; modifiers not known are passed over."""
    out = []
    for part in _split(text):
        part = part.strip()
        m = re.match(r"(\w+)\(([^()]+)\)(.*)\Z", part)
        head, *mods = (m[3] if m else part).split(".")
        field = parse_key(m[2] if m else head)
        mods = [x.lower() for x in mods]
        nulls = "first" if "nullsfirst" in mods else "last" if "nullslast" in mods else None
        out.append(Order(field, "desc" in mods, nulls, m[1] if m else None))
    return tuple(out)


def whole(text: str, what: str) -> int:
    if not re.fullmatch(r"\d+", text.strip()):
        raise bad_request(f"{what} takes a whole number, not {text!r}")
    return int(text)


@dataclass(frozen=True)
class Query:
    """A parsed query string."""

    read: Read
    columns: tuple[str, ...] | None = None
    on_conflict: tuple[str, ...] = ()
    args: tuple[tuple[str, str], ...] = ()


def parse_query(text: str, table: str, schema: str | None = None, routine: set[str] | None = None) -> Query:
    """Parameters in order of their keys; the last `select` holds, `order` lists add up.

    With routine (the names of a function's parameters) keys among them, and those that begin
    with an underscore, are arguments.
    """
    pairs = []
    for part in text.lstrip("?").split("&"):
        if part:
            key, _, value = part.partition("=")
            pairs.append((unquote(key), unquote(value)))
    read = Read(table, schema)
    where: list[Tree] = []
    having: list[Tree] = []
    below: dict[tuple[str, ...], Below] = {}
    columns: tuple[str, ...] | None = None
    conflict: tuple[str, ...] = ()
    args: list[tuple[str, str]] = []
    for key, value in sorted(pairs, key=lambda p: p[0]):
        *path, last = key.split(".") if "." in key and key not in RESERVED else [key]
        if path and path[-1] == "not" and last in ("and", "or"):
            path, last = path[:-1], f"not.{last}"
        at = tuple(path)
        if routine is not None and not path and (key in routine or key.startswith("_")):
            args.append((key, value))
        elif at and (last in ("order", "limit", "offset", "and", "or", "not.and", "not.or") or last not in RESERVED):
            b = below.get(at, Below())
            if last == "order":
                b = replace(b, order=b.order + parse_order(value))
            elif last in ("limit", "offset"):
                b = replace(b, **{last: whole(value, last)})
            elif last.endswith(("and", "or")) and last in RESERVED:
                b = replace(b, where=(*b.where, parse_logic(last.removeprefix("not."), value, last.startswith("not."))))
            else:
                b = replace(b, where=(*b.where, parse_filter(parse_key(last), value)))
            below[at] = b
        elif key == "select":
            read = replace(read, select=parse_select(value))
        elif key == "order":
            read = replace(read, order=read.order + parse_order(value))
        elif key in ("limit", "offset"):
            read = replace(read, **{key: whole(value, key)})
        elif key == "columns":
            columns = tuple(parse_key(c.strip()).name for c in _split(value))
        elif key == "on_conflict":
            conflict = tuple(parse_key(c.strip()).name for c in _split(value))
        elif key in ("and", "or", "not.and", "not.or"):
            where.append(parse_logic(key.removeprefix("not."), value, key.startswith("not.")))
        elif key == "having":
            having.append(parse_logic("and", value))
        elif key == "distinct":
            read = replace(read, distinct=value.lower() not in ("false", "0", ""))
        else:
            where.append(parse_filter(parse_key(key), value))
    return Query(replace(read, where=tuple(where), having=tuple(having), below=below), columns, conflict, tuple(args))
