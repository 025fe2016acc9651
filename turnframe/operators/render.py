"""F-18, F-19, O-5, P-12: chat-template rendering and token truncation.

Re-aimed: the reference delegates both to the model's tokenizer, whose
template and vocabulary are not part of its inputs.  ``render_chat`` uses
ChatML (the public format of the default model family) with the template
strings as parameters; it runs as native array functions.
``tokenize_truncate`` takes the model's tokenizer as a batch function, run
per Arrow batch in a Pandas UDF; without one, ``text_tokens`` gives word and
punctuation strings (no ids).  Truncation keeps the first ``max_length``
tokens, without padding.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import WS_CLASS

# Word runs, or any single other non-space character.
TOKEN_REGEX = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + WS_CLASS[1:-1] + "]"


def render_chat(messages: Column, add_generation_prompt: bool = False,
                start: str = C.CHATML_MESSAGE_START, end: str = C.CHATML_MESSAGE_END,
                generation_prompt: str = C.CHATML_GENERATION_PROMPT) -> Column:
    """``<start>{role}\\n{content}<end>`` per message, concatenated, plus
    the generation prompt when asked."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit(start), m["role"], F.lit("\n"), m["content"], F.lit(end))), "")
    return F.concat(body, F.lit(generation_prompt)) if add_generation_prompt else body


def to_text(df: DataFrame, messages_col: str = "messages", keep: list[str] | None = None) -> DataFrame:
    """P-12: after rendering keep only ``text`` (plus ``keep``)."""
    return df.select(*(keep or []), render_chat(F.col(messages_col)).alias("text"))


def regex_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_REGEX), 0)


def text_tokens(df: DataFrame, max_length: int = C.DEFAULT_MAX_SEQ_LENGTH, text_col: str = "text",
                keep: list[str] | None = None) -> DataFrame:
    """``tokens``: the first ``max_length`` word and punctuation strings of
    a text; ``text`` is dropped (P-12)."""
    return df.select(*(keep or []), F.slice(regex_tokens(F.col(text_col)), 1, max_length).alias("tokens"))


def tokenize_truncate(df: DataFrame, tokenizer: Callable[[list[str]], list[list[int]]],
                      max_length: int = C.DEFAULT_MAX_SEQ_LENGTH, text_col: str = "text",
                      keep: list[str] | None = None) -> DataFrame:
    """``input_ids`` and ``attention_mask``, truncated to ``max_length``, no
    padding; ``text`` is dropped (P-12).  ``tokenizer`` is a batch function
    ``list[str] -> list[list[int]]``, for example a wrapper of a tokenizer's
    ``encode_batch``."""
    @F.pandas_udf("array<int>")
    def _encode(texts: pd.Series) -> pd.Series:
        return pd.Series(tokenizer(texts.tolist()))

    ids = F.slice(_encode(F.col(text_col)), 1, max_length)
    return df.select(*(keep or []), ids.alias("input_ids")).withColumn(
        "attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
