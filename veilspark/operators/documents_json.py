"""Redaction of JSON of any shape: string by string, by path, everything else byte for byte.

A document is read token by token.  Its string values are leaves with a path; each is redacted, and only those in which something is
replaced are written anew, so numbers, spacing, key order and escapes elsewhere stay as they are.  An element of an array called
``parts`` whose ``type`` isn't known passes unchanged as a whole.  Keys are not redacted.

NULL stays NULL; what isn't JSON is redacted as one plain text; blank strings pass.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.operators.detector import Detector
from veilspark.operators.kernel import LazyKernel

#: Kinds of part that are searched; None searches all.
KNOWN = frozenset({"text", "reasoning", "tool", "file"})
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]', re.DOTALL)
RESULT = pa.struct([("json", pa.string()), ("n", pa.int32()), ("paths", pa.list_(pa.string()))])
RESULT_DDL = "struct<json:string,n:int,paths:array<string>>"


class _Frame:
    """An object or array that is open: key or index, the first of its leaves, and for an element of ``parts`` its type."""

    __slots__ = ("at", "first", "is_key", "is_object", "is_part", "kind")

    def __init__(self, is_object: bool, first: int, is_part: bool) -> None:
        self.is_object, self.first, self.is_part = is_object, first, is_part
        self.at, self.is_key, self.kind = ("" if is_object else 0), is_object, None


def string_leaves(text: str, known: frozenset[str] | None = KNOWN) -> list[tuple[int, int, str]]:
    """(start, end, path) of the string values of valid JSON that are searched; start and end are those of the token with its quotes."""
    leaves: list[tuple[int, int, str]] = []
    open_: list[_Frame] = []

    def path() -> str:
        return "$" + "".join(f".{f.at}" if f.is_object else f"[{f.at}]" for f in open_)

    for token in _TOKEN.finditer(text):
        c, top = token[0], open_[-1] if open_ else None
        if c in "{[":
            part = c == "{" and top is not None and not top.is_object and len(open_) > 1 and open_[-2].is_object and open_[-2].at == "parts"
            open_.append(_Frame(c == "{", len(leaves), part))
        elif c in "}]":
            frame = open_.pop()
            if frame.is_part and known is not None and frame.kind not in known:
                del leaves[frame.first :]
        elif c == ",":
            if top.is_object:
                top.is_key = True
            else:
                top.at += 1
        elif c != ":":
            if top is not None and top.is_object and top.is_key:
                top.at, top.is_key = json.loads(c, strict=False), False
                continue
            if top is not None and top.is_object and top.at == "type":
                top.kind = json.loads(c, strict=False)
            leaves.append((token.start(), token.end(), path()))
    return leaves


def redact_json_text(text: str | None, run, known: frozenset[str] | None = KNOWN) -> dict:
    """``run`` gives the kernel's result for a plain text."""
    if text is None:
        return {"json": None, "n": 0, "paths": None}
    try:
        json.loads(text, strict=False)
    except (ValueError, RecursionError):
        done = run(text)
        return {"json": done["text"] if done["replacements"] or done["truncated"] else text, "n": done["replacements"], "paths": ["$"] if done["replacements"] else []}
    out, at, n, paths = [], 0, 0, []
    for start, end, path in string_leaves(text, known):
        value = json.loads(text[start:end], strict=False)
        done = run(value) if value.strip() else None
        if done and (done["replacements"] or done["truncated"]):
            out += [text[at:start], json.dumps(done["text"], ensure_ascii=False)]
            at, n = end, n + done["replacements"]
            paths.append(path)
    return {"json": "".join([*out, text[at:]]), "n": n, "paths": paths}


def redact_json(text: Column | str, detector: Detector | None = None, known: frozenset[str] | None = KNOWN) -> Column:
    """struct<json, n, paths> for a column of JSON strings: the document, how many replacements, and the paths of the strings that changed."""
    config = (detector or Detector.whole()).config
    kernel = LazyKernel(config, entropy=config.entropy.enabled and config.entropy.mode == "auto")

    @F.arrow_udf(RESULT_DDL)
    def redact(column: pa.Array) -> pa.Array:
        run = kernel().filter
        return pa.array([redact_json_text(x, run, known) for x in column.to_pylist()], RESULT)

    return redact(F.col(text) if isinstance(text, str) else text)


def redact_variant(value: Column | str, detector: Detector | None = None, known: frozenset[str] | None = KNOWN) -> Column:
    """A VARIANT column with its strings redacted."""
    return F.parse_json(redact_json(F.to_json(F.col(value) if isinstance(value, str) else value), detector, known)["json"])
