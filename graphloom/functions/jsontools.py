"""JSON of model replies repaired, and results made compact. Driver-side or inside UDFs, on small values."""

from __future__ import annotations

import json
import re
from typing import Any

_THINK = re.compile(r"<think>.*?(?:</think>|\Z)", re.S)
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def repair_json(reply: str | None) -> Any:
    """The JSON value of a model's reply, or None.

    Tried in turn: the reply itself, a fenced block, the outermost braces, and
    what is left after cutting at the last complete element and closing what is
    open. Thinking sections, doubled colons and trailing commas are removed.
    """
    if not reply:
        return None
    text = _THINK.sub("", reply).strip()
    text = re.sub(r'"\s*:\s*"\s*:\s*"', '": "', re.sub(r'"\s*::\s*', '": ', text))
    fenced = _FENCE.search(text)
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    tries = [text, fenced[1] if fenced else None]
    if at >= 0:
        body = text[at:]
        end = max(body.rfind("}"), body.rfind("]"))
        tries += [body[: end + 1], body]
    for t in tries:
        if not t:
            continue
        for fixed in (t, re.sub(r",\s*([}\]])", r"\1", t)):
            try:
                return json.loads(fixed)
            except ValueError:
                pass
    return _closed(text[at:]) if at >= 0 else None


def _closed(text: str) -> Any:
    """The longest beginning that becomes JSON once its brackets are closed."""
    open_, points, quoted, escaped = [], [], False, False
    for i, c in enumerate(text):
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
            points.append((i + 1, tuple(open_)))
        elif c in "}]":
            if not open_ or open_.pop() != c:
                break
            points.append((i + 1, tuple(open_)))
        elif c == ",":
            points.append((i, tuple(open_)))
    for end, left in reversed(points):
        try:
            value = json.loads(text[:end].rstrip().rstrip(",") + "".join(reversed(left)))
        except ValueError:
            continue
        return _without_empty(value)
    return None


def _without_empty(value: Any) -> Any:
    if isinstance(value, list):
        return [_without_empty(v) for v in value if v != {}]
    if isinstance(value, dict):
        return {k: _without_empty(v) for k, v in value.items()}
    return value


def strip_nulls(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: strip_nulls(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [strip_nulls(v) for v in value if v is not None]
    return value


def _type_name(values: list) -> str:
    first = next((v for v in values if v is not None), None)
    for kind, name in ((bool, "bool"), (int, "int"), (float, "float")):
        if isinstance(first, kind):
            return name
    return "str"


def tabular(rows: Any, least: int = 3) -> Any:
    """Three or more records as one schema and rows of values; anything else unchanged."""
    if not isinstance(rows, list) or len(rows) < least or not all(isinstance(r, dict) for r in rows):
        return rows
    keys = sorted({k for r in rows for k in r})
    return {"format": "tson", "schema": [f"{k}:{_type_name([r.get(k) for r in rows])}" for k in keys], "data": [[r.get(k) for k in keys] for r in rows]}


def compact(value: Any) -> str:
    """Without nulls, lists of records as tables, without blanks."""

    def walk(v: Any) -> Any:
        if isinstance(v, dict):
            return {k: walk(x) for k, x in v.items()}
        return tabular([walk(x) for x in v]) if isinstance(v, list) else v

    try:
        return json.dumps(walk(strip_nulls(value)), separators=(",", ":"), ensure_ascii=False)
    except (TypeError, ValueError) as e:
        return json.dumps({"error": str(e)}, separators=(",", ":"))
