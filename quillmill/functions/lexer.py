"""Tokens of program texts, with the state that a reader of brackets, strings and comments keeps: a table function over rows.

One pass over a text. Strings, comments and brackets are told apart from code; a bracket that is never closed ends with the text, and a
closing one without an opener is left out. Each token knows

* its statement and the function whose body it stands in (scope: the number of the function's own token, 0 outside),
* the calls that enclose it, from the outermost on, and in which argument of each it stands,
* the assignment or return on whose right side it stands.

Kinds: name (a dotted name is one), callee, call (the bracket behind a callee; `text` is the callee, `stop` the end of the call), number, string, template
(a string with values inside), op, open, assign (`text` is the target), return, function (`text` is its name, `params` its parameters). Closing brackets and commas
between arguments give no row. Bodies are found by braces, after `def` by indentation. Regular expressions between slashes
and unnamed functions aren't told apart: the body of an unnamed function belongs to the function around it.

Defined results: null and empty texts have no tokens; line numbers count from 1, positions from 0 in characters; a text may be of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRING = "[rbfuRBFU]{0,2}(?:" + r'"""(?:\\.|.)*?(?:"""|\Z)|' + r"'''(?:\\.|.)*?(?:'''|\Z)|" + r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|' + r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|`(?:\\.|[^`\\])*(?:`|\Z))"
_PARTS = [("space", r"[^\S\n]+"), ("end", r"\n"), ("remark", None), ("string", _STRING), ("number", r"\d[\w.]*"), ("name", r"\.?[^\W\d][\w$]*(?:\.[^\W\d][\w$]*)*|\$[\w$]*(?:\.[^\W\d][\w$]*)*"), ("op", r"\.\.\.|=>|===?|!==?|<=|>=|[-+*/%&|^.]=|\+\+|--|&&|\|\||.")]
_REMARK = {True: r"\#[^\n]*", False: r"//[^\n]*|/\*.*?(?:\*/|\Z)"}
_LEXERS = {h: re.compile("|".join(f"(?P<{n}>{p or _REMARK[h]})" for n, p in _PARTS), re.S) for h in (True, False)}
_VALUES, _NAME = re.compile(r"\{[^{}]*\}"), re.compile(r"(?<![\w.])[^\W\d][\w$]*(?:\.[^\W\d][\w$]*)*")
#: Words that are no names of values or functions.
WORDS = frozenset("if else elif for while do switch case catch try finally with return new await typeof not and or in is lambda var let const final async yield throw raise function def func class import from export".split())
DEFINES = frozenset(("function", "def", "func"))
LITERALS = frozenset("true false null none undefined nan".split())
_SETS = frozenset(("=", "+=", ".="))
#: What an opening brace follows where it begins a value rather than a block.
_VALUE = frozenset(("=", "+=", "(", "[", ",", ":", "return", "?", "||", "&&", "+"))
_CLOSES = {")": "(", "]": "[", "}": "{"}

SCHEMA = "seq int, kind string, text string, line int, start int, stop int, stmt int, scope int, head int, within array<struct<call: int, n: int>>, params array<string>"
_FIELDS = [("seq", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("line", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("stmt", pa.int32()), ("scope", pa.int32()), ("head", pa.int32())]
_MOST = 1 << 14
_WITHIN = pa.list_(pa.struct([("call", pa.int32()), ("n", pa.int32())]))


class _Open:
    __slots__ = ("char", "token", "call", "n", "value", "scope")

    def __init__(self, char, token, call=None, value=False, scope=None):
        self.char, self.token, self.call, self.n, self.value, self.scope = char, token, call, 0, value, scope


def tokens_of(code: str | None, hash_comments: bool = False) -> list[dict]:
    """Tokens of a text, as rows of SCHEMA."""
    out: list[dict] = []
    stack: list[_Open] = []
    scopes: list[tuple[int, int]] = []  # (function, indentation of its def)
    line, line_start, stmt, head, fresh = 1, 0, 1, None, True
    last: dict | None = None  # the token before, opening brackets and words included
    header: dict | None = None  # a function whose body hasn't begun
    params_of: _Open | None = None
    body_after: dict | None = None

    def scope() -> int:
        inner = next((o.scope for o in reversed(stack) if o.scope), 0)
        return max(inner, scopes[-1][0] if scopes else 0)

    def put(kind: str, text: str, start: int, stop: int) -> dict:
        calls = [{"call": o.call, "n": o.n} for o in stack if o.call is not None]
        row = {"seq": len(out) + 1, "kind": kind, "text": text, "line": line, "start": start, "stop": stop, "stmt": stmt, "scope": scope(), "head": head, "within": calls, "params": None}
        out.append(row)
        return row

    def cut() -> None:
        nonlocal stmt, head
        stmt, head = stmt + 1, None

    for m in _LEXERS[hash_comments].finditer(code or ""):
        kind, text, start = m.lastgroup, m.group(), m.start()
        if kind in ("space", "remark"):
            line += text.count("\n")
            continue
        inside = bool(stack) and (stack[-1].char != "{" or stack[-1].value)
        if kind == "end":
            line, line_start = line + 1, m.end()
            if not inside and not (last and last["kind"] == "op" and last["text"] not in (";", ":", "++", "--")):
                cut()
                fresh = True
            continue
        if fresh and not inside:
            while scopes and start - line_start <= scopes[-1][1]:
                scopes.pop()
            fresh = False
        if kind == "name" and text in WORDS:
            if text in DEFINES:
                header = put("function", "", start, m.end())
                header["indent"] = start - line_start if text == "def" else None
            if text == "return":
                head = put("return", "", start, m.end())["seq"]
            last = {"kind": "word", "text": text}
        elif kind == "name":
            if header is not None and not header["text"] and params_of is None:
                header["text"], last = text, {"kind": "header", "text": text}
                continue
            if params_of is not None and stack and stack[-1] is params_of and last["text"] in ("(", ",", "*", "**", "..."):
                header["params"].append(text)
            last = put("literal" if text.lower() in LITERALS else "name", text, start, m.end())
        elif kind in ("string", "number"):
            quote = text.lstrip("rbfuRBFU")
            mixed = kind == "string" and ((quote[:1] == "`" and "${" in quote) or ("f" in text[: len(text) - len(quote)].lower() and "{" in quote))
            last = put("template" if mixed else kind, text, start, m.end())
            for part in _VALUES.finditer(text) if mixed else ():  # names between braces are used here
                for name in _NAME.finditer(part.group()):
                    if name.group() not in WORDS:
                        put("name", name.group(), start + part.start() + name.start(), start + part.start() + name.end())
            line += text.count("\n")
        elif text in "([{":
            row = call = None
            value = text != "{" or (last is not None and last["text"] in _VALUE and last["kind"] in ("op", "open", "word"))
            if text == "(" and header is not None and params_of is None and header["params"] is None:
                header["params"] = []
                params_of = _Open(text, None)
                stack.append(params_of)
            elif text == "{" and body_after is not None:
                cut()
                stack.append(_Open(text, None, scope=body_after["seq"]))
                body_after = None
            elif text == "(" and last is not None and last["kind"] == "name":
                last["kind"] = "callee"
                row = put("call", last["text"], start, len(code))
                stack.append(_Open(text, row, call=row["seq"]))
            else:
                if value:
                    row = put("open", text, start, len(code))
                else:
                    cut()
                stack.append(_Open(text, row, call=call, value=value))
            last = {"kind": "open", "text": text}
        elif text in ")]}":
            if any(o.char == _CLOSES[text] for o in stack):
                while True:  # what was opened inside and never closed ends here too
                    o = stack.pop()
                    if o.token is not None:
                        o.token["stop"] = m.end()
                    if o is params_of:
                        params_of, body_after, header = None, header, None
                    if o.char == _CLOSES[text]:
                        break
                if text == "}" and not o.value:
                    cut()
                last = o.token if o.token is not None and o.token["kind"] == "call" else {"kind": "close", "text": text}
        else:
            if text == ";" and not inside:
                cut()
                body_after = None
            elif text == "," and stack and stack[-1].call is not None:
                stack[-1].n += 1
            elif text == ":" and body_after is not None and body_after.get("indent") is not None and not inside:
                cut()
                scopes.append((body_after["seq"], body_after["indent"]))
                body_after = None
            elif text in _SETS and not inside and head is None and (target := _target(out, stmt)) is not None:
                target["kind"] = "target"
                row = put("assign", target["text"], start, m.end())
                head = row["seq"]
                if text != "=":  # what the target held stays in it
                    put("name", target["text"], start, start)
            elif text not in ",;":
                put("op", text, start, m.end())
            last = {"kind": "op", "text": text}
    for row in out:
        row.pop("indent", None)
    return out


def _target(out: list[dict], stmt: int) -> dict | None:
    """The name that an assignment sets: the only one before it, the last of a type and a name, the first before an annotation."""
    names = []
    for row in reversed(out):
        if row["stmt"] != stmt:
            break
        names.append(row)
    names.reverse()
    if len(names) >= 3 and names[0]["kind"] == "name" and names[1]["text"] == ":":
        return names[0]
    return names[-1] if names and all(x["kind"] == "name" for x in names) else None


def _rows(hash_at: int | None, hash_comments: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, kind = [batch.schema.names[0], *(n for n, _ in _FIELDS), "within", "params"], batch.schema.field(0).type
            keys, held = [], []
            for i in range(batch.num_rows):
                h = bool(batch.column(hash_at)[i].as_py()) if hash_at is not None else hash_comments
                rows = tokens_of(batch.column(1)[i].as_py(), h)
                held += rows
                keys += [batch.column(0)[i].as_py()] * len(rows)
                if len(held) < _MOST and i + 1 < batch.num_rows:
                    continue
                for lo in range(0, len(held), _MOST):  # short texts share a batch, long ones are cut
                    some = held[lo : lo + _MOST]
                    cols = [pa.array([r[n] for r in some], t) for n, t in _FIELDS] + [pa.array([r["within"] for r in some], _WITHIN), pa.array([r["params"] for r in some], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + _MOST], kind), *cols], names=names)
                keys, held = [], []

    return run


def tokens(df: DataFrame, key: str, code: str, hash_comments: bool | Column = False) -> DataFrame:
    """(key, SCHEMA): tokens of all texts. hash_comments: whether # begins a comment, else // and /* do; a column decides by row."""
    by_row = isinstance(hash_comments, Column)
    cols = [F.col(f"`{key}`"), F.col(f"`{code}`").cast("string").alias("__code")] + ([hash_comments.alias("__hash")] if by_row else [])
    kind = df.schema[key].dataType.simpleString()
    return df.select(*cols).mapInArrow(_rows(2 if by_row else None, False if by_row else hash_comments), f"`{key}` {kind}, {SCHEMA}")
