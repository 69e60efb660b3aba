"""JSON objects in free text and the verdicts of triage replies."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import col

_MARK = re.compile(r'\\.|["{}]', re.S)
_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S)
_KEYS = ("is_confirmed", "has_vulnerability")
_FIELDS = ["is_confirmed", "reason", "vulnerability_type", "fix_suggestion", "source", "sink", "explanation"]
TRIAGE = StructType([StructField(f, StringType()) for f in _FIELDS])


def objects_in(text: str) -> list[str]:
    """Outermost pieces in balanced braces, in order; braces inside quotes don't count, and what never closes is left out."""
    out, opened, depth, quoted = [], 0, 0, False
    at = 0
    while m := _MARK.search(text, at):
        at, token = m.end(), m.group()
        if token[0] == "\\":
            if not quoted:
                at = m.start() + 1  # a backslash escapes inside quotes only
        elif token == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif token == "{":
            if not depth:
                opened = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append(text[opened : m.end()])
    return out


@F.pandas_udf(ArrayType(StringType()))
def _objects(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: objects_in(t) if t is not None else [])


def json_objects(text) -> Column:
    """All complete objects in braces in a text, from left to right; null texts have none."""
    return _objects(col(text))


def triage(reply: str | None) -> dict | None:
    """The verdict of a reply: the first object with a verdict key, in fenced blocks before the whole text; then a bare key and value."""
    if not reply:
        return None
    for part in [*_FENCE.findall(reply), reply]:
        for piece in objects_in(part):
            try:
                found = json.loads(piece)
            except ValueError:
                continue
            if not isinstance(found, dict):
                continue
            key = next((k for k in _KEYS if k in found), None)
            if key is None:
                continue
            said = {k: "" if found.get(k) is None else str(found[k]) for k in ("vulnerability_type", "fix_suggestion", "source", "sink", "explanation")}
            reason = str(found.get("reason") or "").strip() or ("" if key == _KEYS[0] else said["explanation"].strip())
            value = found[key]
            return {"is_confirmed": json.dumps(value) if not isinstance(value, str) else value, "reason": reason, **said}
    for k in _KEYS:
        if m := re.search(rf'"{k}"\s*:\s*(true|false)', reply, re.I):
            return {"is_confirmed": m.group(1).lower()}
    return None


@F.pandas_udf(TRIAGE)
def _triage(replies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([{**dict.fromkeys(_FIELDS), **(triage(r) or {})} for r in replies], columns=_FIELDS, dtype=object)


def triage_verdict(reply) -> Column:
    """Struct of strings; is_confirmed is null where no verdict can be read."""
    return _triage(col(reply))


# fixed values: fields of a verdict and how each stands in a reply that is no JSON, first quoted, then as an item of a list
FIELDS = ("has_vulnerability", "vulnerability_type", "risk_level", "source", "sink", "explanation", "fix_suggestion")
_QUOTED = {f: re.compile(rf'"{f}"\s*:\s*"([^"]+)"' if f == "risk_level" else rf'"{f}"\s*:\s*"(.*?)(?=",\s*"|"\s*}})') for f in FIELDS[1:]}
_LISTED = {f: re.compile(rf'\*{{0,2}}{f}\*{{0,2}}\s*:\s*"?([^"\n*]+)"?(?=\s*\n|$)', re.I) for f in FIELDS[1:]}
_STATED = [re.compile(r'"has_vulnerability"\s*:\s*(true|false|null|"[^"]*"|\d+)', re.I), re.compile(r'\*{0,2}has_vulnerability\*{0,2}\s*:\s*(true|false|null|none|"[^"]*"|\d+)', re.I)]
_WORDS = {"true": "true", "1": "true", "false": "false", "0": "false", "null": None, "none": None}
VERDICT = StructType([StructField("tier", StringType()), *[StructField(f, StringType()) for f in FIELDS]])


def _object(piece: str) -> dict | None:
    """A JSON object with the key of a verdict; strings in a row where one value should stand are put together."""
    for text in (piece, _joined(piece)):
        try:
            found = json.loads(text)
        except ValueError:
            continue
        return found if isinstance(found, dict) and FIELDS[0] in found else None
    return None


_STRINGS = re.compile(r'"([^"]*)"')
_ROW = re.compile(r'("(?:' + "|".join(FIELDS) + r')"\s*:)\s*"[^"]*"(?:\s*,\s*"[^"]*"(?=\s*[,}]))+')


def _joined(piece: str) -> str:
    """`"sink": "one", "two", "source": ...` -> `"sink": "one two", "source": ...`: strings without a colon behind them belong to the field before."""
    return _ROW.sub(lambda m: f'{m.group(1)} "{" ".join(x for x in _STRINGS.findall(m.group()[len(m.group(1)) :]) if x)}"', piece)


def _pieces_from_every_brace(text: str):
    """Balanced pieces from each opening brace on, outer ones before those inside."""
    todo = [text]
    while todo:
        part = todo.pop()
        found = objects_in(part)
        if not found and (at := part.find("{")) >= 0:
            found, rest = [], part[at + 1 :]  # the first one never closes: what stands behind it may
            todo.append(rest)
            continue
        at, nested = 0, []
        for piece in found:
            yield piece
            nested.append(piece[1:-1])
            at = part.index(piece, at) + len(piece)
        rest = part[at:]
        todo += [x for x in ([rest] if "{" in rest[rest.find("{") + 1 :] else []) + nested[::-1] if "{" in x]


def verdict(reply: str | None) -> dict | None:
    """The verdict of a reply and the tier it was read at.

    fence: the first object of a fenced block, the last block that has one with the key; text: an object with the key anywhere, outer before inner;
    fields: field by field, quoted or as a list. Else, and of a null or empty reply, None.
    """
    if not reply:
        return None
    for block in reversed(_FENCE.findall(reply)):
        if (pieces := objects_in(block)) and (found := _object(pieces[0])) is not None:
            return {"tier": "fence", **found}
    for piece in _pieces_from_every_brace(reply):
        if f'"{FIELDS[0]}"' in piece and (found := _object(piece)) is not None:
            return {"tier": "text", **found}
    stated = next((m for p in _STATED if (m := p.search(reply))), None)
    if stated is None or (value := stated.group(1).strip('"').lower()) not in _WORDS:
        return None
    out = {"tier": "fields", FIELDS[0]: _WORDS[value]}
    for f in FIELDS[1:]:
        if m := _QUOTED[f].search(reply) or _LISTED[f].search(reply):
            out[f] = m.group(1).strip()
    return out


def _said(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


@F.pandas_udf(VERDICT)
def _verdict(replies: pd.Series) -> pd.DataFrame:
    rows = [verdict(r) or {} for r in replies]
    return pd.DataFrame([{"tier": r.get("tier"), **{f: _said(r.get(f)) for f in FIELDS}} for r in rows], columns=["tier", *FIELDS], dtype=object)


def verdict_of(reply) -> Column:
    """Struct of strings: tier (fence, text, fields; null: no verdict) and the fields of a verdict, values that aren't strings as JSON."""
    return _verdict(col(reply))
