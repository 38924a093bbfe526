"""Chat messages as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.constants import IMAGE_USER_PROMPT, TRAINING_SYSTEM_PROMPT


def assistant_text(messages: Column, schema: T.ArrayType) -> Column:
    """Text of the first usable assistant turn, '' when there is none.

    ``content`` is either a string or a list of typed parts; ``schema`` tells which. A turn
    without a text part (or with a NULL string) falls through to the next one.
    """
    by_assistant = F.filter(messages, lambda m: m["role"] == "assistant")
    if isinstance(schema.elementType["content"].dataType, T.StringType):
        usable = F.filter(by_assistant, lambda m: m["content"].isNotNull())
        text = F.get(usable, F.lit(0))["content"]
    else:
        parts = F.transform(
            by_assistant, lambda m: F.filter(m["content"], lambda p: p["type"] == "text"))
        usable = F.filter(parts, lambda found: F.size(found) > 0)
        text = F.get(F.get(usable, F.lit(0)), F.lit(0))["text"]
    return F.coalesce(text, F.lit(""))


def training_messages(
    code: Column,
    system_prompt: str = TRAINING_SYSTEM_PROMPT,
    user_prompt: str = IMAGE_USER_PROMPT,
) -> Column:
    """System, user (image placeholder and text) and assistant turns."""
    def part(kind, text):
        return F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"))

    def turn(role, *parts):
        return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))

    return F.array(
        turn("system", part("text", F.lit(system_prompt))),
        turn("user", part("image", F.lit(None)), part("text", F.lit(user_prompt))),
        turn("assistant", part("text", code)),
    )
