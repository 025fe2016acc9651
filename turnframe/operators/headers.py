"""P-1: recognise export header lines and split them into fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.memo import with_once
from ..functions.text import strip
from ..functions.timestamps import export_timestamp, iso_string

_MARKERS = "".join(f"\\x{{{ord(m):X}}}" for m in C.LEADING_MARKERS)
# (?d): only "\n" ends a line, like Python's "." and "$"; \p{Nd} is Python's
# Unicode \d.  Groups: month, day, year, hour, minute, second, speaker, text.
HEADER_REGEX = (
    "(?d)^[" + _MARKERS + "]?"
    r"\[(\p{Nd}{1,2})/(\p{Nd}{1,2})/(\p{Nd}{2}), (\p{Nd}{1,2}):(\p{Nd}{2}):(\p{Nd}{2})\] "
    r"([^:]+): (.*)$"
)
# One regex pass rewrites a header into colon-separated fields.  No group
# before the text can contain ':', so a split with limit 8 is exact.
_FIELDS = "$1:$2:$3:$4:$5:$6:$7:$8"

def is_header(value: Column) -> Column:
    """A header starts with '[' or with one marker then '[': that cheap test
    runs first, the full pattern only on candidates."""
    return (F.instr(F.substring(value, 1, 2), "[") > 0) & F.regexp_like(value, F.lit(HEADER_REGEX))


def with_header(df: DataFrame, value_col: str = "value", out: str = "h", known_header: bool = False) -> DataFrame:
    """``df`` plus the header struct ``out``: ``(is_header, ts, speaker,
    text)``, with the one regex pass that splits the fields evaluated once per
    line.  Other lines give ``is_header=false`` and NULL fields; ``ts`` is
    NULL for a date or time that does not exist; ``speaker`` is stripped,
    ``text`` is raw.  ``known_header`` skips the test of every line."""
    value = F.col(value_col)
    hdr = F.lit(True) if known_header else is_header(value)
    parts = F.when(hdr, F.split(F.regexp_replace(value, F.lit(HEADER_REGEX), F.lit(_FIELDS)), ":", 8))
    df = with_once(df, "__hparts", parts)
    g = [F.get(F.col("__hparts"), i) for i in range(8)]
    ts = export_timestamp(g[0], g[1], g[2], g[3], g[4], g[5])
    h = F.when(F.col("__hparts").isNotNull(),
               F.struct(F.lit(True).alias("is_header"), ts.alias("ts"), strip(g[6]).alias("speaker"),
                        g[7].alias("text"))).otherwise(
        F.struct(F.lit(False).alias("is_header"), F.lit(None).cast("timestamp_ntz").alias("ts"),
                 F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("text")))
    return with_once(df, out, h).drop("__hparts")


ON_BAD = ("fail", "null", "quarantine")


def checked_timestamps(messages: DataFrame, where: Column, on_bad: str, ts_col: str = "__ts") -> DataFrame:
    """Messages with ``timestamp`` (ISO text) in place of the parsed header
    time ``ts_col``.  With ``on_bad='fail'`` a header date that does not exist
    fails the run.  That is a filter here, upstream of every drop rule and
    projection, so it also holds for messages that are dropped later and for
    outputs without a timestamp.  ``'null'`` and ``'quarantine'`` keep the
    message with a NULL timestamp."""
    if on_bad not in ON_BAD:
        raise ValueError(f"on_bad must be one of {ON_BAD}")
    if on_bad == "fail":
        bad = F.raise_error(F.concat(F.lit("unparsable export timestamp at "), where)).cast("boolean")
        messages = messages.where(F.when(F.col(ts_col).isNotNull(), F.lit(True)).otherwise(bad))
    return messages.withColumn("timestamp", iso_string(F.col(ts_col))).drop(ts_col)
