"""Headers and methods: what is asked of a resource, apart from the query string."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from larkspur.errors import ApiError, bad_request
from larkspur.plans.ir import Prefer, Read

_PREFER = {
    "resolution": ("merge-duplicates", "ignore-duplicates"),
    "return": ("representation", "headers-only", "minimal"),
    "count": ("exact", "planned", "estimated"),
    "tx": ("commit", "rollback"),
    "missing": ("default", "null"),
    "handling": ("strict", "lenient"),
    "params": ("single-object", "multiple-objects"),
}
_FIELD = {"resolution": "resolution", "return": "representation", "count": "count", "tx": "transaction", "missing": "missing", "handling": "handling", "params": "params"}


def parse_prefer(header: str | None) -> Prefer:
    """The first of repeated preferences holds; unknown ones are errors under handling=strict."""
    out, unknown, applied = Prefer(), [], []
    for part in re.split(r"[,;]", header or ""):
        part = part.strip()
        if not part:
            continue
        key, _, value = (x.strip() for x in part.partition("="))
        if key in _PREFER and value in _PREFER[key]:
            if getattr(out, _FIELD[key]) is None:
                out = replace(out, **{_FIELD[key]: value})
                applied.append(f"{key}={value}")
        elif key == "timezone" and value:
            out = replace(out, timezone=value)
            applied.append(part)
        elif key == "max-affected" and value.isdigit():
            out = replace(out, max_affected=int(value))
            applied.append(part)
        else:
            unknown.append(part)
    if unknown and out.handling == "strict":
        raise bad_request("unknown preferences: " + ", ".join(unknown))
    return replace(out, applied=tuple(applied))


def parse_range(header: str | None) -> tuple[int, int | None] | None:
    """`a-b` or `a-`: the first row and how many."""
    if not header:
        return None
    m = re.fullmatch(r"\s*(?:items\s*=\s*)?(\d+)-(\d*)\s*", header)
    if not m:
        return None
    first, last = int(m[1]), m[2]
    if last and int(last) < first:
        raise ApiError("range", "range_not_satisfiable", f"the range {header} ends before it begins")
    return first, int(last) - first + 1 if last else None


def resolve_range(read: Read, header: tuple[int, int | None] | None, most: int | None) -> Read:
    """Query parameters over the header, both under the ceiling. offset=0 leaves the header's offset."""
    limit, offset = read.limit, read.offset
    if header:
        limit = header[1] if limit is None else limit
        offset = offset or header[0]
    return replace(read, limit=limit, offset=offset).capped(most)


@dataclass(frozen=True)
class Media:
    """What to render: json, csv, singular (object), text, binary; nulls: leave nulls out, or let a singular be null."""

    kind: str = "json"
    strip_nulls: bool = False
    nullable: bool = False
    plan: str | None = None
    plan_options: tuple[str, ...] = ()


def parse_accept(header: str | None) -> Media:
    for part in (header or "*/*").split(","):
        kind, *params = (x.strip() for x in part.split(";"))
        kind = kind.lower()
        params_ = dict(p.partition("=")[::2] for p in params)
        nulls = params_.get("nulls", "")
        if kind in ("application/json", "*/*", "application/*", "application/geo+json", "application/openapi+json", "application/xml", "text/xml"):
            return Media("json")
        if kind.startswith("application/vnd.") and kind.endswith(".array+json"):
            return Media("json", strip_nulls=nulls == "stripped")
        if kind.startswith("application/vnd.") and kind.endswith(".object+json"):
            return Media("singular", strip_nulls=nulls == "stripped", nullable=nulls == "null")
        if kind.startswith("application/vnd.") and (m := re.search(r"\.plan(?:\+(json|text))?$", kind)):
            return Media("plan", plan=m[1] or "text", plan_options=tuple(params_.get("options", "").split("|")))
        if kind == "text/csv":
            return Media("csv")
        if kind == "text/plain":
            return Media("text")
        if kind == "application/octet-stream":
            return Media("binary")
    raise ApiError("not_acceptable", "media_type", f"cannot render {header}")


@dataclass(frozen=True)
class Action:
    """kind: root, read, insert, update, upsert, delete, call, info."""

    kind: str
    resource: str = ""
    headers_only: bool = False
    read_only: bool = True


def parse_action(method: str, path: str) -> Action:
    method, parts = method.upper(), [p for p in path.split("/") if p]
    if parts and parts[0] == "rpc":
        if len(parts) != 2:
            raise ApiError("not_found", "resource", f"no resource {path}")
        if method == "OPTIONS":
            return Action("info", parts[1])
        if method not in ("GET", "HEAD", "POST"):
            raise ApiError("method_not_allowed", "method", f"{method} cannot call a function")
        return Action("call", parts[1], method == "HEAD", method in ("GET", "HEAD"))
    if len(parts) > 1:
        raise ApiError("not_found", "resource", f"no resource {path}")
    if not parts:
        if method in ("GET", "HEAD", "OPTIONS"):
            return Action("root", "", method == "HEAD")
        raise ApiError("method_not_allowed", "method", f"{method} does not apply to the root")
    kinds = {"GET": "read", "HEAD": "read", "POST": "insert", "PATCH": "update", "PUT": "upsert", "DELETE": "delete", "OPTIONS": "info"}
    if method not in kinds:
        raise ApiError("method_not_allowed", "method", f"unknown method {method}")
    return Action(kinds[method], parts[0], method == "HEAD", method in ("GET", "HEAD", "OPTIONS"))


def parse_schema(schemas: tuple[str, ...], headers: dict[str, str], read_only: bool) -> str:
    """The profile headers choose among the exposed schemas."""
    asked = headers.get("accept-profile") if read_only else headers.get("content-profile") or headers.get("accept-profile")
    asked = asked or headers.get("content-profile")
    if asked is None:
        return schemas[0]
    if asked not in schemas:
        raise ApiError("not_acceptable", "schema_not_exposed", f"Schema {asked} is not among: {', '.join(schemas)}")
    return asked
