"""Validity checks on generated diagram code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom import constants as C
from gradeloom.functions.arrays import let
from gradeloom.functions.text import trim_space

START, END = "@startuml", "@enduml"


def _verdict(error: Column) -> Column:
    return let(error, lambda e: F.struct(
        e.isNull().alias("valid"), F.coalesce(e, F.lit("")).alias("error")))


def check_diagram(code: Column) -> Column:
    """``struct<valid, error>`` of the local, case-sensitive check."""
    def first_error(text):
        body = F.substr(text, F.lit(len(START) + 1), F.length(text) - len(START) - len(END))
        return (
            F.when(~F.startswith(text, F.lit(START)), C.MISSING_START)
            .when(~F.endswith(text, F.lit(END)), C.MISSING_END)
            .when(trim_space(body) == "", C.EMPTY_BODY)
        )
    return _verdict(
        F.when(F.coalesce(code, F.lit("")) == "", C.EMPTY_RESPONSE)
        .otherwise(let(trim_space(code), first_error))
    )


def preflight_diagram(code: Column) -> Column:
    """Error of the case-insensitive check before rendering, NULL when it passes."""
    text = F.coalesce(code, F.lit(""))
    return (
        F.when(~text.rlike("(?iu)" + START), C.PREFLIGHT_MISSING_START)
        .when(~text.rlike("(?iu)" + END), C.PREFLIGHT_MISSING_END)
    )


# The image signature and the name of its text chunks, in hexadecimal.
PNG_SIGNATURE = "89504E470D0A1A0A"
TEXT_CHUNK = "74455874"


def _utf8(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def _text_chunks(body: Column) -> Column:
    """The error-bearing text chunks of a PNG: one nullable field per watched key.

    A chunk is a 4-byte length, a 4-byte name, the data and a 4-byte checksum, so its place
    depends on the one before: the walk is a fold. A later chunk of a key replaces an
    earlier one.
    """
    size = F.length(body)
    keys = C.ERROR_CHUNK_KEYS
    none = F.lit(None).cast("string")

    def state(at, values):
        return F.struct(at.alias("at"), *[v.alias(f"v{i}") for i, v in enumerate(values)])

    def visit(acc):
        at = acc["at"]
        old = [acc[f"v{i}"] for i in range(len(keys))]
        length = F.conv(F.hex(F.substr(body, at + 1, F.lit(4))), 16, 10).cast("long")
        after = at + 12 + length

        def read_text(data):
            cut = F.instr(F.decode(data, "ISO-8859-1"), F.lit("\0"))
            key = _utf8(F.substr(data, F.lit(1), cut - 1))
            value = _utf8(F.substr(data, cut + 1, F.length(data)))
            return state(after, [
                F.when((cut > 0) & (key == k), value).otherwise(o) for k, o in zip(keys, old)
            ])

        is_text = F.hex(F.substr(body, at + 5, F.lit(4))) == TEXT_CHUNK
        data = F.substr(body, (at + 9).cast("int"), F.least(length, size.cast("long")).cast("int"))
        return F.when(is_text, let(data, read_text)).otherwise(state(after, old))

    start = state(F.lit(8).cast("long"), [none] * len(keys))
    most = F.greatest(F.ceil(size / 12).cast("int"), F.lit(1))
    walked = F.aggregate(
        F.sequence(F.lit(1), most), start,
        lambda acc, _: F.when(acc["at"] < size - 12, visit(acc)).otherwise(acc),
    )
    is_png = F.hex(F.substr(body, F.lit(1), F.lit(8))) == PNG_SIGNATURE
    return F.when(is_png, walked)


def image_error(body: Column) -> Column:
    """Error text found in a rendered image, NULL when it looks clean."""
    def reported(value):
        text = trim_space(value)
        worded = reduce(lambda a, b: a | b,
                        [F.contains(F.lower(text), F.lit(w)) for w in C.ERROR_WORDS])
        return F.when((text != "") & worded, text)

    def in_chunks(chunks):
        return F.coalesce(*[reported(chunks[f"v{i}"]) for i in range(len(C.ERROR_CHUNK_KEYS))])

    def in_bytes(raw):
        def context(marker):
            at = F.instr(raw, F.lit(marker))
            begin = F.greatest(F.lit(1), at - 20)
            cut = F.substr(raw, begin, at + 120 - begin)
            shown = trim_space(F.regexp_replace(cut, r"[^\x20-\x7E\n]", ""))
            return F.when(at > 0, F.coalesce(F.nullif(shown, F.lit("")), F.lit(marker)))
        return F.coalesce(*[context(m) for m in C.ERROR_MARKERS])

    return F.coalesce(
        let(_text_chunks(body), in_chunks),
        let(F.decode(body, "ISO-8859-1"), in_bytes),
    )


def render_error(http_code: Column, reason: Column, content_type: Column, body: Column) -> Column:
    """Error of one captured rendering response, NULL when the diagram is accepted."""
    kind, why = F.coalesce(content_type, F.lit("")), F.coalesce(reason, F.lit(""))
    code = http_code.cast("string")
    return (
        F.when(http_code.isNull(), F.concat(F.lit("HTTP request failed: "), why))
        .when(http_code == 400, C.RENDER_REJECTED)
        .when((http_code < 200) | (http_code >= 300),
              F.concat(F.lit(C.RENDER_HTTP_ERROR), code, F.lit(": "), why))
        .when(~F.contains(kind, F.lit("image/")), F.concat(F.lit(C.RENDER_CONTENT_TYPE), kind))
        .otherwise(F.concat(F.lit(C.RENDER_REPORTED), image_error(body)))
    )
