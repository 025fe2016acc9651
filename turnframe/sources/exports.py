"""S-1 .. S-3b, S-4, S-5, S-6: readers.

* ``read_exports(path)``: whole files via ``binaryFile`` (one row per file,
  bytes decoded with U+FFFD replacement, BOM kept).  A single file of any
  extension, or every ``*.txt`` under a folder, recursively.
* ``explode_lines(files)``: whole-file rows -> numbered lines.
* ``read_export_lines(path)``: the line reader for files too large for one
  row: Spark's text source splits files, and line numbers come from one
  sketch row a split (no per-file task, no shuffle of lines, two scans).
* ``read_jsonl_lines``, ``read_transcripts``, ``read_chat_dataset``.

Deviation kept from Spark's file index: names starting with ``_`` or ``.``
are skipped when listing a folder (the reference reads them).
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.memo import with_once
from ..functions.text import NEWLINE_REGEX, drop_trailing_empty
from ..session import materialize

CHAT_SCHEMA = "messages array<struct<role:string,content:string>>"


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath) and fs.getFileStatus(hpath).isFile()


# Tasks of a listing job: this many, or four a core.
LISTING_TASKS = 64
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _few_listing_tasks(spark: SparkSession):
    """Spark lists folders when a reader is loaded, up to 10,000 of them in a
    task each, and starting a task takes longer than listing a folder; fewer tasks keep
    all cores busy."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), max(LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def export_files(spark: SparkSession, path: str | list[str], glob: str | None = "*.txt") -> DataFrame:
    """The input files as ``binaryFile`` rows, listed here and only once: the
    path itself if it is a file, else every file below it that the glob fits.
    Like Spark's reads, names starting with ``_`` or ``.`` are skipped."""
    reader = spark.read.format("binaryFile")
    if glob and isinstance(path, str) and not _is_file(spark, path):
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    elif not glob and isinstance(path, str):
        reader = reader.option("recursiveFileLookup", "true")
    with _few_listing_tasks(spark):
        return reader.load(path)


def export_index(spark: SparkSession, path: str | list[str], files: DataFrame | None = None) -> DataFrame:
    """The input files as ``(source_path, length)`` through Spark's file
    index (parallel listing; the content column is pruned, so nothing is
    read).  ``files``: those of ``export_files``, if they are listed already."""
    files = export_files(spark, path) if files is None else files
    return files.select(F.col("path").alias("source_path"), "length")


# Broadcast the per-split table of the line reader up to this many bytes.
SPLIT_TABLE_BROADCAST_MAX = 64 << 20
SPLIT_ROW_BYTES = 64  # beside the path


def count_input_files(spark: SparkSession, path: str, files: DataFrame | None = None) -> int:
    """Number of input files, zero-length ones included (the reference
    counts them; Spark's scan skips them, its file index does not)."""
    return len(export_index(spark, path, files)._jdf.inputFiles())  # the array's length, not its paths


def metadata_path(col: str = "_metadata.file_path"):
    """File path as the ``binaryFile`` source writes it.  ``_metadata``
    paths are URI strings (``file:///a%20b.txt``); decode them (a literal
    '+' is protected, the decoder would turn it into a space) and use the
    short ``file:/`` form, so both readers give the same path."""
    decoded = F.url_decode(F.regexp_replace(F.col(col), r"\+", "%2B"))
    return F.regexp_replace(decoded, "^file:///", "file:/")


def read_exports(spark: SparkSession, path: str | list[str], max_length: int | None = None,
                 files: DataFrame | None = None) -> DataFrame:
    """``(source_path, content)``, one row per file: the path itself if it is
    a file, else every ``*.txt`` below it.  ``max_length`` leaves out longer
    files (the source reads none of their bytes)."""
    raw = export_files(spark, path) if files is None else files
    if max_length is not None:
        raw = raw.where(F.col("length") <= max_length)
    return raw.select(F.col("path").alias("source_path"),
                      F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def explode_lines(files: DataFrame, path_col: str = "source_path", text_col: str = "content") -> DataFrame:
    """Whole-file rows -> ``(source_path, line_no, value)`` with Python's
    universal newlines; 1-based; no extra line after a final newline."""
    raw = with_once(files.select(F.col(path_col).alias("source_path"), F.col(text_col).alias("__text")),
                    "__parts", F.split(F.col("__text"), NEWLINE_REGEX, -1))
    return raw.select(
        "source_path",
        F.posexplode(drop_trailing_empty(F.col("__parts"))).alias("pos", "value"),
    ).select("source_path", (F.col("pos") + 1).cast("long").alias("line_no"), "value")


def read_export_lines(spark: SparkSession, path: str | list[str], glob: str | None = "*.txt",
                      min_file_size: int | None = None, files: DataFrame | None = None) -> DataFrame:
    """Line-level reader for exports of any size: ``(source_path, line_no,
    value)``, in two scans and without a shuffle of lines.

    The text source cuts files at line feeds; inside a split its rows are
    read in order, so their ``monotonically_increasing_id`` values are
    consecutive.  The first scan makes one row a split (see ``split_sketch``):
    rows, first id, bytes read.  From it follow the lines before each split
    and whether a file begins with a byte order mark, which the source drops
    and line 1 gets back, so both readers give the same lines.  The second scan
    numbers its rows by ``lines in earlier splits + (id - first id) + 1`` and
    takes a carriage return off their ends.

    Rows with a carriage return inside are several lines; files with such rows
    (seen in the sketch) are cut at all line ends by the source, in two more
    scans of theirs.  ``files``: those of ``export_files``, if they are listed already."""
    scan = scan_text(spark, path, glob, lineSep="\n")
    sketch = materialize(split_sketch(scan, min_file_size), "split-sketch")
    marked = sketch.where("marked").select("source_path", F.lit(True).alias("__marked")).distinct()
    small = _sketch_bytes(spark, export_files(spark, path, glob) if files is None else files, min_file_size) <= SPLIT_TABLE_BROADCAST_MAX
    hint = F.broadcast if small else lambda df: df
    lone = sketch.where("lone").select("source_path").distinct()
    rows = _numbered_rows(scan, sketch.where(~F.col("lone")), min_file_size, hint)
    lines = rows.withColumn("value", F.replace("value", F.lit("\r"), F.lit("")))  # at most one, the last character
    if not lone.isEmpty():
        cut = scan_text(spark, path, glob)
        places = split_sketch(cut, min_file_size).join(hint(lone), "source_path", "left_semi")
        lines = lines.unionByName(_numbered_rows(cut, places, min_file_size, hint))
    mark = F.when(F.col("__marked") & (F.col("line_no") == 1), F.lit("\ufeff")).otherwise(F.lit(""))
    lines = lines.join(hint(marked), "source_path", "left")
    return lines.select("source_path", "line_no", F.concat(mark, F.make_valid_utf8(F.col("value"))).alias("value"))


def _scanned(scan: DataFrame, min_file_size: int | None) -> DataFrame:
    """The scan's rows with file, split and id."""
    if min_file_size is not None:
        # Only files larger than this (the others go through the whole-file
        # route); a filter on file metadata, no path list on the driver.
        scan = scan.where(F.col("_metadata.file_size") > F.lit(min_file_size))
    return scan.select(
        metadata_path().alias("source_path"),
        F.col("_metadata.file_block_start").alias("__split"),
        F.col("_metadata.file_size").alias("__size"),
        F.monotonically_increasing_id().alias("__mid"),
        F.col("value"),
    )


def split_sketch(scan: DataFrame, min_file_size: int | None = None) -> DataFrame:
    """One row a split of a text scan: ``(source_path, __split, __first,
    __before, marked, lone)``: first row id, rows in earlier splits of the
    file, and of the whole file whether it begins with a byte order mark and
    whether a row has a carriage return that is not its last character.

    The source takes a byte order mark off: cut at line feeds, a file's
    values and their line feeds add up to its size, or to one more without a
    final line feed; with three bytes taken off they add up to less."""
    raw = _scanned(scan, min_file_size)
    returns = F.octet_length("value") - F.octet_length(F.replace("value", F.lit("\r"), F.lit("")))
    lone = (returns > 1) | ((returns == 1) & ~F.endswith("value", F.lit("\r")))
    found = raw.groupBy("source_path", "__split").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"), F.max("__size").alias("__size"),
        F.sum(F.octet_length("value") + 1).alias("__read"), F.max(lone).alias("__lone"))
    file = Window.partitionBy("source_path")
    before = F.sum("__n").over(file.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1))
    return found.select("source_path", "__split", "__first", F.coalesce(before, F.lit(0)).alias("__before"),
                        (F.max("__size").over(file) - F.sum("__read").over(file) >= 2).alias("marked"),
                        F.max("__lone").over(file).alias("lone"))


def _numbered_rows(scan: DataFrame, sketch: DataFrame, min_file_size: int | None, hint) -> DataFrame:
    """The rows of the files in the sketch with their line numbers."""
    places = hint(sketch.select("source_path", "__split", "__first", "__before"))
    number = (F.col("__before") + F.col("__mid") - F.col("__first") + 1).cast("long").alias("line_no")
    return _scanned(scan, min_file_size).join(places, ["source_path", "__split"]).select("source_path", number, "value")


def _sketch_bytes(spark: SparkSession, files: DataFrame, min_file_size: int | None) -> int:
    """Bound on the sketch's size from the file listing (no content read):
    each file has at most ceil(size / maxPartitionBytes) + 1 splits."""
    idx = files.select(F.col("path").alias("source_path"), "length")
    if min_file_size is not None:
        idx = idx.where(F.col("length") > F.lit(min_file_size))
    row_bytes = F.length("source_path") * 4 + SPLIT_ROW_BYTES
    return idx.agg(F.sum((F.ceil(F.col("length") / F.lit(_split_bytes(spark, idx))) + 1) * row_bytes)).first()[0] or 0


def scan_text(spark: SparkSession, path: str | list[str], glob: str | None, **options) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").options(**options)
    if glob and isinstance(path, str) and not _is_file(spark, path):
        reader = reader.option("pathGlobFilter", glob)
    with _few_listing_tasks(spark):
        return reader.text(path)


def _split_bytes(spark: SparkSession, index: DataFrame) -> int:
    """Smallest size at which Spark cuts the listed files, as it sets it."""
    conf = spark._jsparkSession.sessionState().conf()
    largest, open_cost = conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes()
    total = index.agg(F.sum(F.col("length") + F.lit(open_cost))).first()[0] or 0
    return max(1, min(largest, max(open_cost, total // max(1, spark.sparkContext.defaultParallelism))))


def read_jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSONL text -> ``(line_no, value, source_path)``: one file, or every
    file of a folder such as Spark's JSON output (line numbers are per
    file; the input order is file, then line)."""
    lines = read_export_lines(spark, path, glob=None)
    return lines.select("line_no", "value", "source_path")


def read_transcripts(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """S-6: transcript files -> ``(transcript_id, seq, text)``
    (``transcript_id`` = file path); see ``operators.chat.context_lines``
    for the line split.  ``whole``: one piece per file; otherwise one piece
    per line from the split-aware line reader (files of any size)."""
    if not whole:
        lines = read_export_lines(spark, path, glob=None)
        return lines.select(F.col("source_path").alias("transcript_id"), F.col("line_no").alias("seq"),
                            F.col("value").alias("text"))
    df = spark.read.text(path, wholetext=True)
    return df.select(metadata_path().alias("transcript_id"), F.lit(0).alias("seq"),
                     F.make_valid_utf8(F.col("value")).alias("text"))


def read_chat_dataset(spark: SparkSession, train: str, val: str | None = None) -> DataFrame:
    """S-5: JSONL chat rows as split ``train`` and optional ``validation``."""
    df = spark.read.schema(CHAT_SCHEMA).json(train).withColumn("split", F.lit("train"))
    if val:
        df = df.unionByName(spark.read.schema(CHAT_SCHEMA).json(val).withColumn("split", F.lit("validation")))
    return df
