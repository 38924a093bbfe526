"""Model requests as JSON lines, and their ids."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.constants import (
    IMAGE_SYSTEM_PROMPT, IMAGE_URI_PREFIX, IMAGE_USER_PROMPT, REQUEST_URL,
    TEXT_SYSTEM_PROMPT, TEXT_USER_PREFIX,
)
from gradeloom.functions.text import trim_space


def request_id(row_idx: Column) -> Column:
    return F.concat(F.lit("req_"), row_idx.cast("string"))


def parse_request_id(custom_id: Column) -> Column:
    """The row of a request id; NULL when the id has another form."""
    return F.split_part(custom_id, F.lit("_"), F.lit(2)).try_cast("bigint")


def image_uri(image: Column) -> Column:
    """Bytes as a data URI; Spark breaks base64 into lines, which a URI must not have."""
    return F.concat(F.lit(IMAGE_URI_PREFIX), F.translate(F.base64(image), "\r\n", ""))


def _message(role: str, content: Column) -> Column:
    return F.to_json(F.struct(F.lit(role).alias("role"), content.alias("content")))


def _image_content(image: Column, user_prompt: str) -> Column:
    # NULL fields are left out of the JSON, so each part keeps only its own field.
    no_url = F.lit(None).cast("struct<url:string>")
    return F.array(
        F.struct(F.lit("text").alias("type"), F.lit(user_prompt).alias("text"),
                 no_url.alias("image_url")),
        F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
                 F.struct(image_uri(image).alias("url")).alias("image_url")),
    )


def chat_body(
    source: Column,
    kind: str,
    model: str,
    system_prompt: str | None = None,
    user_prompt: str | None = None,
    max_tokens: int | None = None,
) -> Column:
    """Request body for one image (bytes) or one text; NULL for a NULL source."""
    if kind == "image":
        system = system_prompt or IMAGE_SYSTEM_PROMPT
        user = _message("user", _image_content(source, user_prompt or IMAGE_USER_PROMPT))
    elif kind == "text":
        system = system_prompt or TEXT_SYSTEM_PROMPT
        prefix = F.lit(user_prompt or TEXT_USER_PREFIX)
        user = _message("user", F.concat(prefix, trim_space(source)))
    else:
        raise ValueError(f"kind must be 'image' or 'text', not {kind!r}")
    tail = '],"temperature":0.0' + (f',"max_tokens":{max_tokens}' if max_tokens else "") + "}"
    body = F.concat(
        F.lit(f'{{"model":{json.dumps(model, ensure_ascii=False)},"messages":['),
        _message("system", F.lit(system)), F.lit(","), user, F.lit(tail),
    )
    return F.when(source.isNotNull(), body)


def request_line(row_idx: Column, body: Column) -> Column:
    """One line of a batch request file."""
    return F.concat(
        F.lit('{"custom_id":"'), request_id(row_idx),
        F.lit(f'","method":"POST","url":"{REQUEST_URL}","body":'), body, F.lit("}"),
    )
