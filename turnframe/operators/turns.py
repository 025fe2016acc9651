"""S-4 / P-9 .. P-11 / F-10 .. F-12: typed turn records from JSONL lines;
O-1 / W-2: the timeline order and the 0-based turn index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_digits, digit_not_decimal_class, strip
from ..functions.timestamps import is_aware, iso_sort_key
from ..functions.memo import with_once
from .ordinals import global_ordinal

_INTEGRAL = ["TINYINT", "SMALLINT", "INT", "BIGINT"]


def _kind(v: Column, path: str) -> Column:
    """Variant type name of a top-level field; NULL when the key is absent,
    'VOID' for JSON null."""
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


_FIELDS = {"ts": "$.timestamp", "sp": "$.speaker", "tx": "$.text", "src": "$.source_file", "ls": "$.line_start"}


def _python_str(kind: Column, s: Column) -> Column:
    """``str(value)`` of a JSON field as Python prints it, for the types that
    occur in practice (string, null, boolean, integer, decimal); ``s`` is the
    variant cast to string."""
    return (F.when(kind == "STRING", s)
            .when(kind == "VOID", F.lit("None"))
            .when(kind == "BOOLEAN", F.when(s == "true", F.lit("True")).otherwise(F.lit("False")))
            .otherwise(s))


def _line_start(kind: Column, s: Column) -> tuple[Column, Column]:
    """(value, whether it has none): integers, booleans and digit strings
    count, anything else is 0; digits that are no number and integers of more
    than 64 bits have no value."""
    # a decimal is an integer too long for 64 bits, or was written with a point or exponent
    integral = kind.isin(_INTEGRAL) | (kind.startswith("DECIMAL") & F.regexp_like(s, F.lit(r"^-?\d{19,}$")))
    decimal_digits = F.regexp_like(s, F.lit(r"^\p{Nd}+$"))
    any_digits = F.regexp_like(s, F.lit(r"^(?:\p{Nd}|" + digit_not_decimal_class() + ")+$"))
    number = (F.when(integral, s.try_cast("bigint"))
              .when(kind == "BOOLEAN", (s == "true").cast("bigint"))
              .when((kind == "STRING") & decimal_digits, ascii_digits(s).try_cast("bigint")))
    expected = F.coalesce(integral | ((kind == "STRING") & any_digits), F.lit(False))
    return F.coalesce(number, F.lit(0).cast("bigint")), expected & number.isNull()


def _classified(lines: DataFrame, line_col: str, value_col: str) -> tuple[DataFrame, list[str]]:
    """Non-blank lines with their fields, the turn they make and ``reject``,
    the reason why a line cannot be read (else NULL)."""
    # The last of duplicate keys counts; VARIANT parsing rejects duplicates
    # unless this is on.
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    carry = [F.col("source_path").alias("input_file")] if "source_path" in lines.columns else []
    keep = ["input_file"] if carry else []
    base = with_once(lines.select(*carry, F.col(line_col).cast("long").alias("input_line"), F.col(value_col).alias("__value")),
                     "__s", strip(F.col("__value"))).where(F.length("__s") > 0)
    base = with_once(base, "__v", F.try_parse_json(F.col("__s")))
    v = F.col("__v")
    shape = F.schema_of_variant(v)
    f = F.struct(F.when(v.isNull(), "not JSON").when(~shape.startswith("OBJECT"), "not an object").alias("bad_shape"),
                 *[_kind(v, p).alias(f"k_{k}") for k, p in _FIELDS.items()],
                 *[F.try_variant_get(v, p, "string").alias(f"s_{k}") for k, p in _FIELDS.items()])
    fields = with_once(base, "__f", f).select(*keep, "input_line", "__value", "__f.*")
    is_str = lambda k: F.coalesce(F.col(f"k_{k}") == "STRING", F.lit(False))
    usable = is_str("ts") & is_str("sp") & is_str("tx") & F.coalesce(F.length(strip(F.col("s_tx"))) > 0, F.lit(False))
    number, no_number = _line_start(F.col("k_ls"), F.col("s_ls"))
    nested = F.coalesce(F.col("k_src").rlike("^(ARRAY|OBJECT)"), F.lit(False))
    reject = F.coalesce("bad_shape", F.when(usable & nested, "source_file is no plain value"),
                        F.when(usable & no_number, "line_start is no integer of 64 bits"))
    return fields.withColumns({"usable": usable, "line_start": number, "reject": reject}), keep


ON_BAD = ("fail", "fail_first", "skip", "quarantine")


def turns_from_json(lines: DataFrame, on_bad: str = "fail", line_col: str = "line_no",
                    value_col: str = "value") -> DataFrame:
    """JSONL lines ``(line_no, value)`` -> turns.

    Blank lines are skipped.  Rows whose ``timestamp``, ``speaker`` or
    ``text`` is not a JSON string, or whose text is blank, are dropped;
    ``source_file`` and ``line_start`` become text and integer.  A line that
    cannot be read (no JSON object, a nested ``source_file``, a ``line_start``
    without an integer value) raises naming its number with ``'fail'`` (one
    pass: the first task to meet one; with several any may be named), names
    the first one with ``'fail_first'`` (a second pass), and is left out with
    ``'skip'`` and ``'quarantine'``; ``json_rejects`` returns those lines.
    Output: ``timestamp, speaker, text, source_file, line_start, input_line``
    (plus ``input_file`` when the lines carry ``source_path``: the input
    order for the timeline's tie-break is then file, line).

    Fields are extracted once into columns (type name and string value per
    field) so each projection stays small enough for whole-stage codegen.
    """
    if on_bad not in ON_BAD:
        raise ValueError(f"on_bad must be one of {ON_BAD}")
    rows, keep = _classified(lines, line_col, value_col)
    good = F.col("reject").isNull()
    if on_bad == "fail":
        said = F.concat(F.lit("input line "), F.col("input_line").cast("string"), F.lit(": "), F.col("reject"))
        rows = rows.where(F.when(good, F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
    else:
        if on_bad == "fail_first":
            first = rows.where(~good).agg(F.min(F.struct("input_line", "reject")).alias("m")).first()["m"]
            if first is not None:
                raise ValueError(f"input line {first['input_line']}: {first['reject']}")
        rows = rows.where(good)
    return rows.where("usable").select(
        F.col("s_ts").alias("timestamp"),
        strip(F.col("s_sp")).alias("speaker"),
        strip(F.col("s_tx")).alias("text"),
        F.when(F.col("k_src").isNull(), F.lit("unknown"))
         .otherwise(_python_str(F.col("k_src"), F.col("s_src"))).alias("source_file"),
        "line_start", *keep, "input_line",
    )


def json_rejects(lines: DataFrame, line_col: str = "line_no", value_col: str = "value") -> DataFrame:
    """The lines that ``turns_from_json`` cannot read: ``input_line``, the
    line and the reason (plus ``input_file``)."""
    rows, keep = _classified(lines, line_col, value_col)
    return rows.where(F.col("reject").isNotNull()).select(*keep, "input_line", F.col("__value").alias("value"), "reject")


def turn_index(turns: DataFrame, tiebreak: list[Column | str] | None = None,
               partition_by: list[str] | None = None, out: str = "turn_idx",
               on_bad: str = "fail", num_partitions: int | None = None) -> DataFrame:
    """The timeline with ``turn_idx``; see ``turn_index_with_count``."""
    return turn_index_with_count(turns, tiebreak, partition_by, out, on_bad, num_partitions)[0]


def turn_index_with_count(turns: DataFrame, tiebreak: list[Column | str] | None = None,
                          partition_by: list[str] | None = None, out: str = "turn_idx",
                          on_bad: str = "fail", num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """Add the 0-based position of each turn in the timeline.

    Order: ``fromisoformat(timestamp)``, ``source_file``, ``line_start``,
    then ``tiebreak`` (the input order: JSONL line number, or the file path
    split into components), which must make the order total so that the
    index is deterministic, as the reference's stable sort is.

    ``partition_by=None`` is one timeline over everything (the reference);
    with keys, every key gets its own 0-based timeline and the column
    ``timeline_turns`` (that timeline's length).

    Plan: range partitioning on the whole key and per-partition offsets
    (``ordinals.global_ordinal``); never a window without a partition key.
    ``turn_index_with_count`` also returns the number of turns.
    """
    keys = list(partition_by or [])
    sort_ts = iso_sort_key(F.col("timestamp"))
    df = turns.withColumn("__ts", sort_ts)
    if on_bad == "fail":
        df = df.withColumn("__ts", F.when(F.col("__ts").isNotNull(), F.col("__ts")).otherwise(
            F.raise_error(F.concat(F.lit("no ISO time: "), F.col("timestamp"))).cast("timestamp_ntz")))
    elif on_bad == "skip":
        df = df.where(F.col("__ts").isNotNull())
    else:
        raise ValueError("on_bad must be 'fail' or 'skip'")
    tb = []
    for i, c in enumerate(tiebreak or []):
        df = df.withColumn(f"__tb{i}", F.col(c) if isinstance(c, str) else c)
        tb.append(f"__tb{i}")
    order = [*keys, "__ts", "source_file", "line_start", *tb]
    gidx = "__gidx" if keys else out
    indexed, total = global_ordinal(df, [F.col(c) for c in order], gidx, num_partitions, label="timeline",
                                    uniform=is_aware(F.col("timestamp")))
    if keys:
        # One aggregate gives each key's first global index and its length;
        # one join (broadcast by AQE when small) applies both.
        first = indexed.groupBy(*keys).agg(F.min(gidx).alias("__first"), F.count(F.lit(1)).alias("timeline_turns"))
        indexed = (indexed.join(first, on=keys, how="inner")
                   .withColumn(out, F.col(gidx) - F.col("__first")).drop(gidx, "__first"))
    return indexed.drop("__ts", *tb), total
