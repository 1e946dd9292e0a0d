"""Full text without stemming: words are runs of letters and digits, compared in lower case.

A word is looked for by a regular expression with the text's other characters as bounds, so a
predicate needs no tokenised copy of the text; a plain search for the word comes first, and
each text is put into lower case once. The language of a query is accepted by name;
all languages use this one configuration.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.errors import bad_request

LANGUAGES = frozenset("simple english french german spanish italian portuguese dutch danish finnish hungarian norwegian romanian russian swedish turkish".split())
_OTHER = r"[^\p{L}\p{N}]"
_WORD = re.compile(r"[^\W_]+")


def words_of(query: str) -> list[str]:
    return _WORD.findall(query.lower())


def phrase(text: Column, words: list[str], prefix: bool = False) -> Column:
    """The words one right after another in a text in lower case."""
    inside = f"{_OTHER}+".join(words)
    end = "" if prefix else f"({_OTHER}|$)"
    return _all([text.contains(w) for w in dict.fromkeys(words)]) & text.rlike(f"(^|{_OTHER}){inside}{end}")


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def plain(text: Column, query: str) -> Column:
    """All words, anywhere. A query without words matches nothing."""
    words = words_of(query)
    return _all([phrase(text, [w]) for w in words]) if words else F.lit(False)


def phrase_query(text: Column, query: str) -> Column:
    words = words_of(query)
    return phrase(text, words) if words else F.lit(False)


def web(text: Column, query: str) -> Column:
    """Words are required, "quoted phrases" adjacent, -x excluded, `or` between alternatives."""
    groups: list[list[Column]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not minus and word.lower() == "or" and groups[-1]:
            groups.append([])
            continue
        words = words_of(quoted or word)
        if words:
            found = phrase(text, words)
            groups[-1].append(~found if minus else found)
    parts = [_all(g) for g in groups if g]
    if not parts:
        return F.lit(False)
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


_TOKEN = re.compile(r"\s*(<->|[&|!()]|'[^']*'(?::\*)?|[^\s&|!()<>:']+(?::\*)?)")


def boolean(text: Column, query: str) -> Column:
    """& | ! <-> and parentheses; a word may end in :* for any ending."""
    tokens: list[str] = []
    at = 0
    while at < len(query.rstrip()):
        m = _TOKEN.match(query, at)
        if not m:
            raise bad_request(f"syntax error in text query: {query!r}")
        tokens.append(m[1])
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return tokens[pos] if pos < len(tokens) else None

    def take() -> str:
        nonlocal pos
        if pos >= len(tokens):
            raise bad_request(f"text query ends early: {query!r}")
        pos += 1
        return tokens[pos - 1]

    def either() -> Column:
        out = both()
        while peek() == "|":
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = unary()
        while peek() == "&":
            take()
            out = out & unary()
        return out

    def unary() -> Column:
        t = take()
        if t == "!":
            return ~unary()
        if t == "(":
            out = either()
            if take() != ")":
                raise bad_request(f"unbalanced text query: {query!r}")
            return out
        if t in ("&", "|", ")", "<->"):
            raise bad_request(f"syntax error in text query: {query!r}")
        run, prefix = words_of(t.removesuffix(":*").strip("'")), t.endswith(":*")
        while peek() == "<->":
            take()
            t = take()
            run += words_of(t.removesuffix(":*").strip("'"))
            prefix = t.endswith(":*")
        return phrase(text, run, prefix) if run else F.lit(False)

    if not tokens:
        return F.lit(False)
    out = either()
    if peek() is not None:
        raise bad_request(f"syntax error in text query: {query!r}")
    return out


OPERATORS: dict[str, Callable[[Column, str], Column]] = {"fts": boolean, "plfts": plain, "phfts": phrase_query, "wfts": web}


def search(op: str, text: Column, query: str, language: str | None = None) -> Column:
    if language is not None and language.lower() not in LANGUAGES:
        raise bad_request(f"text search configuration {language!r} does not exist")
    return F.exists(F.array(F.lower(text)), lambda t: OPERATORS[op](t, query))
