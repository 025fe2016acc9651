"""E3 (data part) and E4 (prompt side) as Spark plans.

E3: chat JSONL (train and optional validation) -> rendered text (P-12: only
``text`` kept) -> token ids truncated to ``max_length`` (``text`` dropped).
The model training itself is not part of this library (see README).

E4: transcript files -> non-blank context lines -> inference prompts and
their rendered form with the generation prompt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators.chat import context_lines, inference_prompts
from ..operators.render import render_chat, to_text, tokenize_truncate
from ..sources.exports import read_chat_dataset, read_transcripts


def training_tokens(spark: SparkSession, train: str, tokenizer: Callable[[list[str]], list[list[int]]],
                    val: str | None = None, max_length: int = C.DEFAULT_MAX_SEQ_LENGTH) -> DataFrame:
    """``(split, input_ids, attention_mask)`` for the train and validation
    files."""
    chats = read_chat_dataset(spark, train, val)
    text = to_text(chats, keep=["split"])
    return tokenize_truncate(text, tokenizer, max_length, keep=["split"])


def transcript_prompts(spark: SparkSession, path: str, speaker: str | None = None,
                       seed_line: str | None = None, whole: bool = True) -> DataFrame:
    """``(transcript_id, messages, prompt_text)`` for transcript files."""
    pieces = read_transcripts(spark, path, whole=whole)
    lines = context_lines(pieces)
    ids = pieces.select("transcript_id").distinct()
    prompts = inference_prompts(lines, ids, speaker=speaker, seed_line=seed_line)
    return prompts.withColumn("prompt_text", render_chat(F.col("messages"), add_generation_prompt=True))
