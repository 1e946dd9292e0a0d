"""Names: quoting, validity, inflection."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYWORDS = frozenset("all and any array as asc between by case cast check collate column constraint create cross current_date current_timestamp default delete desc distinct drop else end except exists false fetch for foreign from full grant group having in inner insert intersect into is join leading left like limit natural not null offset on or order outer primary references returning right select set some table then to trailing true union unique update user using values when where with".split())


def quote(name: str) -> str:
    """An identifier between backticks."""
    return "`" + name.replace("`", "``") + "`"


def quote_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_valid(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$]{0,62}", name))


def is_keyword(name: str) -> bool:
    return name.lower() in KEYWORDS


def pascal(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"[_\s-]+", name) if p)


def camel(name: str) -> str:
    p = pascal(name)
    return p[:1].lower() + p[1:]


def singular(word: str) -> str:
    if word.endswith("ies") and len(word) > 3:
        return word[:-3] + "y"
    if re.search(r"(ss|sh|ch|x|z)es$", word):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "us", "is")) else word


def plural(word: str) -> str:
    if word.endswith("y") and word[-2:-1] not in "aeiou":
        return word[:-1] + "ies"
    if word.endswith(("s", "sh", "ch", "x", "z")):
        return word if word.endswith("s") and not word.endswith("ss") else word + "es"
    return word + "s"


def key_digest(column: Column) -> Column:
    """What is stored of a secret key: its SHA-256 in hexadecimal."""
    return F.sha2(column.cast("binary"), 256)
