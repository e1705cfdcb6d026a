"""Text normalisation, as native column expressions and as plain Python for the fused kernel.

Order: compatibility form (NFKC), percent-decoding up to three times, entities once,
invisible characters.  NULL stays NULL.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.rules import MAX_TEXT_BYTES

# The invisible characters and the named entities.
INVISIBLE = r"[​-‏﻿­⁠-⁤⁦-⁩︀-️]"
#: What NFKC may change: anything but ASCII and those Latin letters that are composed already (combining marks lie outside). Java finds these some ten times as fast as what is left by a negation.
MAY_CHANGE = r"[\x80-\xBFĲĳĿŀŉſ-\x{10FFFF}]"
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}

_INVISIBLE = re.compile(INVISIBLE)
_PERCENT = re.compile(r"(?s)%(.{0,2})")
_ENTITY = re.compile(r"&([^;]*)(?:;|\Z)")
_HEX_PAIR = re.compile(r"[0-9A-Fa-f]{2}|\+[0-9A-Fa-f]")


def url_decode_once_text(text: str) -> str:
    """A percent sign takes the next two characters along, whether they are digits or not."""
    return _PERCENT.sub(lambda m: chr(int(m[1], 16)) if _HEX_PAIR.fullmatch(m[1]) else m[0], text)


def _entity(match: re.Match[str]) -> str:
    body = match[1]
    if body in ENTITIES:
        return ENTITIES[body]
    digits, base = (body[2:], 16) if body[:2] in ("#x", "#X") else (body[1:], 10)
    if body[:1] == "#" and re.fullmatch(r"\+?[0-9a-fA-F]+" if base == 16 else r"\+?[0-9]+", digits):
        code = int(digits.lstrip("+").lstrip("0")[:12] or "0", base)
        if code < 0xD800 or 0xE000 <= code <= 0x10FFFF:
            return chr(code)
    return f"&{body};"


def html_unescape_text(text: str) -> str:
    """One pass. An ampersand runs to the next semicolon or the end, where one is added."""
    return _ENTITY.sub(_entity, text)


def cap_text(text: str, limit: int = MAX_TEXT_BYTES) -> str:
    """The first ``limit`` bytes, cut at a character."""
    if len(text) * 4 <= limit:
        return text
    data = text.encode("utf-8", "surrogatepass")
    return text if len(data) <= limit else data[:limit].decode("utf-8", "ignore")


def normalize_plain(text: str, url: bool = True, html: bool = True, strip: bool = True) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    for _ in range(3 if url and "%" in text else 0):
        text, before = url_decode_once_text(text), text
        if text == before:
            break
    if html and "&" in text:
        text = html_unescape_text(text)
    return _INVISIBLE.sub("", text) if strip and not text.isascii() else text


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def url_decode_once(text: Column) -> Column:
    return _bound(text, lambda t: F.when(t.contains("%"), _percent_decoded(t)).otherwise(t))


def _percent_decoded(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)%.{0,2}|[^%]+"), F.lit(0))
    decoded = F.transform(
        pieces,
        lambda x: F.when(
            x.rlike(r"^%([0-9A-Fa-f]{2}|\+[0-9A-Fa-f])\z"),
            F.char(F.conv(F.regexp_replace(F.substring(x, 2, 2), r"^\+", ""), 16, 10).cast("int")),
        ).otherwise(x),
    )
    return F.array_join(decoded, "")


def url_decode_iterative(text: Column) -> Column:
    for _ in range(3):
        text = url_decode_once(text)
    return text


def _code_point(number: Column) -> Column:
    return F.when(
        (number < 0xD800) | number.between(0xE000, 0x10FFFF),
        F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"),
    )


def html_unescape(text: Column) -> Column:
    return _bound(text, lambda t: F.when(t.contains("&"), _entities_decoded(t)).otherwise(t))


def _entities_decoded(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)&[^;]*;?|[^&]+"), F.lit(0))

    def decode(x: Column) -> Column:
        body = F.regexp_replace(F.substring(x, 2, 1 << 30), r";\z", "")

        def of(b: Column) -> Column:
            digits = F.regexp_replace(b, r"^#[xX]?\+?0*(?=.)", "")
            named = F.coalesce(*[F.when(b == name, F.lit(value)) for name, value in ENTITIES.items()])
            hexa = F.when(
                b.rlike(r"^#[xX]\+?[0-9a-fA-F]+\z") & digits.rlike(r"^[0-9a-fA-F]{1,6}\z"),
                _code_point(F.conv(digits, 16, 10).cast("bigint")),
            )
            deci = F.when(b.rlike(r"^#\+?[0-9]+\z") & digits.rlike(r"^[0-9]{1,7}\z"), _code_point(digits.cast("bigint")))
            return F.coalesce(named, hexa, deci, F.concat(F.lit("&"), b, F.lit(";")))

        return F.when(x.startswith("&"), _bound(body, of)).otherwise(x)

    return F.array_join(F.transform(pieces, decode), "")


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def is_already_normalized(text: Column) -> Column:
    """No percent code, no invisible character, no entity of the short list; says nothing of NFKC."""
    return ~(text.rlike("%[0-9a-fA-F]{2}") | text.rlike(INVISIBLE) | text.rlike("&(?:amp|lt|gt|quot|#[xX]?[0-9a-fA-F]+);"))


def cap_bytes(text: Column, limit: int = MAX_TEXT_BYTES) -> Column:
    """The first ``limit`` bytes: a character cut by the limit goes as a whole."""
    head = F.substring(F.encode(text, "UTF-8"), 1, limit)
    # at most three bytes of an unfinished character stand at the end
    cut = [F.substring(head, 1, limit - k) for k in range(4)]
    valid = F.coalesce(*[F.try_validate_utf8(c.cast("string")) for c in cut])
    return F.when(F.octet_length(text) > limit, valid).otherwise(text)


def nfkc(text: Column) -> Column:
    """Spark has no function for it, so texts that it may change go through Python; the others, ASCII and plain Latin letters only, go there as NULLs."""

    @F.arrow_udf("string")
    def composed(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in column.to_pylist()], pa.string())

    return F.coalesce(composed(F.when(text.rlike(MAY_CHANGE), text)), text)


def normalize_native(text: Column, url: bool = True, html: bool = True, strip: bool = True, compose: bool = True) -> Column:
    """All steps, in the JVM but for the texts that NFKC may change."""
    text = nfkc(text) if compose else text
    text = url_decode_iterative(text) if url else text
    text = html_unescape(text) if html else text
    return strip_invisible(text) if strip else text
