"""Token-id files: texts to ids, written as independently coded blocks.

Documents are dealt by ranges of doc_id and sorted, each text is encoded by a
tokenizer file and followed by an end id, and each part's ids are cut into
blocks of ``BLOCK_IDS`` ids (a long document runs over several blocks).  A
block is coded by ``idcoder`` from empty tables and carries the crc32 of its
ids, so it can be read, checked and lost on its own.

The file format is a folder of Parquet files with one row a block:

    part, block          place of the block; parts ascend with doc_id
    start                ids of the part before this block
    n_ids, crc32, data   number of ids, checksum, coded ids
    doc_ids, doc_parts   the documents in the block and which part of each
                         document (0 for its first) lies here
    doc_sizes, doc_ends  ids of each document here; whether it ends here

Reading decodes every block by itself, verifies the checksum and joins the
parts of documents that run over blocks.

Null and empty texts are the end id alone; null ids come first; rows that
repeat an id are all written, in the order of their texts; an empty table
gives an empty folder.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .idcoder import VOCABULARY, decode_blocks, encode_blocks
from .staging import checkpoint_root, materialize, texts
from .text import give_back, keep_little, pieces

BLOCK_IDS = 2048
LANES = 2560
PART_BYTES = 32 << 20
CACHE_WORDS = 100_000  # half of them of the round before
JOINED = 512  # new words encoded in one call
END_ID = 2
BLOCK_SCHEMA = ("part int, block long, start long, n_ids long, crc32 long, data binary, doc_ids array<long>, "
                "doc_parts array<long>, doc_sizes array<long>, doc_ends array<boolean>")

# A word with the space before it, white space but its last character, other white space.
# A word of ASCII letters and ASCII signs (no apostrophe) is cut between the two: pretokens end there.
_SIGN = r"[!-&(-/:-@\[-`{-~]"
_PIECES = re.compile(rf" ?[A-Za-z]++(?={_SIGN}*+(?!\S))|{_SIGN}++(?!\S)| ?\S++|\s+(?!\S)|\s")
# These split a text otherwise than Python's white space does, or are tokens of their own.
_WHOLE = re.compile("[\x1c-\x1f]|<\\|")
_LINE = "\n"


class TextEncoder:
    """Ids of texts by a byte-level BPE tokenizer, with words seen before
    kept.  Its pretokens never pass the ends of ``_PIECES``, so texts are
    encoded piece by piece, new words together with a line feed (a token of
    its own) between them."""

    def __init__(self, tokenizer_json: str, keep: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        if self.tokenizer.get_vocab_size() > VOCABULARY:
            raise ValueError(f"ids must be below {VOCABULARY}")
        line = self._ids([_LINE])[0]
        self.line = line[0] if len(line) == 1 else None
        self.keep, self.known, self.before = keep, {}, {}

    def _ids(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        words = [w for w in new if w[-1] not in _LINE and not w.isspace()] if self.line is not None else []
        for at in range(0, len(words), JOINED):
            some = words[at:at + JOINED]
            ids = np.array(self._ids([_LINE.join(some)])[0], "<u2")
            cuts = np.flatnonzero(ids == self.line)
            if len(cuts) != len(some) - 1:
                break  # not such a tokenizer
            raw = ids.tobytes()
            starts, ends = [0, *(2 * cuts + 2).tolist()], [*(2 * cuts).tolist(), len(raw)]
            self.known.update(zip(some, [raw[i:j] for i, j in zip(starts, ends)]))
        rest = [w for w in new if w not in self.known]
        self.known.update(zip(rest, [np.array(x, "<u2").tobytes() for x in self._ids(rest)]))

    def __call__(self, strings: list[str | None]) -> list[bytes]:
        """The ids of every text as 16-bit integers."""
        out: list[bytes] = [b""] * len(strings)
        by_piece, whole = [], []
        for i, s in enumerate(strings):
            if s:
                (whole if _WHOLE.search(s) else by_piece).append(i)
        for i, x in zip(whole, self._ids([strings[i] for i in whole])):
            out[i] = np.array(x, "<u2").tobytes()
        cut = [_PIECES.findall(strings[i]) for i in by_piece]
        if len(self.known) > self.keep // 2:
            self.known, self.before = {}, self.known
        new = set().union(*cut) - self.known.keys()
        if self.before:  # words of the round before go on, those not seen again are forgotten with it
            again = new & self.before.keys()
            self.known.update(zip(again, map(self.before.__getitem__, again)))
            new -= again
        self._learn(list(new))
        get = self.known.__getitem__
        for i, ws in zip(by_piece, cut):
            out[i] = b"".join(map(get, ws))
        return out


class _PartWriter:
    """Cuts a part's ids into blocks and codes many blocks at a time."""

    def __init__(self, part: int, block_ids: int):
        self.part, self.block_ids = part, block_ids
        self.start = self.block = 0
        self.ids = np.zeros(0, np.uint16)
        self.docs: list[tuple] = []  # (doc_id, which part of it, ids here, ends here) of the open block
        self.ready: list[tuple] = []
        self.open: list[np.ndarray] = []
        self.filled = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        at, nth = 0, 0
        while at < len(ids):
            take = min(len(ids) - at, self.block_ids - self.filled)
            self.open.append(ids[at:at + take])
            at += take
            self.filled += take
            self.docs.append((doc_id, nth, take, at == len(ids)))
            nth += 1
            if self.filled == self.block_ids:
                self.close()

    def close(self) -> None:
        if self.filled:
            self.ready.append((self.start, np.concatenate(self.open), self.docs))
            self.start += self.filled
            self.open, self.docs, self.filled = [], [], 0

    def rows(self) -> pa.RecordBatch | None:
        if not self.ready:
            return None
        data = encode_blocks([ids for _, ids, _ in self.ready])
        cols = [pa.array([self.part] * len(data), pa.int32()),
                pa.array(range(self.block, self.block + len(data)), pa.int64()),
                pa.array([s for s, _, _ in self.ready], pa.int64()),
                pa.array([len(i) for _, i, _ in self.ready], pa.int64()),
                pa.array([zlib.crc32(i.astype("<u4").tobytes()) for _, i, _ in self.ready], pa.int64()),
                pa.array(data, pa.binary())]
        for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_())):
            cols.append(pa.array([[d[k] for d in docs] for _, _, docs in self.ready], pa.list_(kind)))
        self.block += len(data)
        self.ready = []
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])


def _write(shared, end_id, block_ids, lanes):
    def run(batches):
        encode = TextEncoder(shared.value)  # one a task: workers live on for other stages, its words do not
        part = _PartWriter(TaskContext.get().partitionId(), block_ids)
        end = np.array([end_id], "<u2").tobytes()
        for b in pieces(batches, 1, 1 << 19):
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                part.add(doc_id, np.frombuffer(ids + end, "<u2"))
            if len(part.ready) >= lanes and (rows := part.rows()) is not None:
                yield rows
        del encode
        part.close()
        if (rows := part.rows()) is not None:
            yield rows
        del part
        give_back()
    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID,
                      block_ids: int = BLOCK_IDS, part_bytes: int = PART_BYTES, lanes: int = LANES) -> None:
    """Writes the ids of all documents (doc_id, text) to a folder."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    d = texts(docs, "doc_id", "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes), spark.sparkContext.defaultParallelism)
    ordered = d.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write(shared, end_id, block_ids, lanes), BLOCK_SCHEMA).write.parquet(folder)


# ---------------------------------------------------------------- reading

def _read(lanes, with_ids):
    def run(batches):
        keep_little()
        held: list[dict] = []

        def rows():
            blocks = decode_blocks([r.pop("data") for r in held], [r["n_ids"] for r in held])
            out = []
            for r, ids in zip(held, blocks):
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != r["crc32"]:
                    raise ValueError(f"block {r['block']} of part {r['part']}: wrong checksum")
                at = 0
                for doc_id, nth, n, ends in zip(r["doc_ids"], r["doc_parts"], r["doc_sizes"], r["doc_ends"]):
                    out.append((r["part"], r["start"] + at, nth, bool(ends), doc_id, n, zlib.crc32(raw[4 * at:4 * (at + n)]),
                                ids[at:at + n].tolist() if with_ids else None))
                    at += n
            held.clear()
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=_PIECE)

        for b in batches:
            for r in b.to_pylist():
                held.append(r)
                if len(held) >= lanes:
                    yield rows()
        if held:
            yield rows()
        give_back()
    return run


_PIECE = ["part", "start", "nth", "ends", "doc_id", "n", "crc", "ids"]
_PIECE_SCHEMA = "part int, start long, nth long, ends boolean, doc_id long, n long, crc long, ids array<int>"


def _gf2_times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


def _zero_bytes() -> list[list[int]]:
    """The maps that move a crc32 on by 1, 2, 4, ... zero bytes."""
    move, out = [0xEDB88320] + [1 << i for i in range(31)], []  # one zero bit
    for k in range(3 + 48):
        if k >= 3:
            out.append(move)
        move = [_gf2_times(move, x) for x in move]
    return out


_MOVES = _zero_bytes()


def join_crc32(a: int, b: int, size_b: int) -> int:
    """crc32 of two byte strings one after the other, from theirs and the
    second's length: ``a`` is moved on by that many zero bytes (a linear map
    of its bits)."""
    for k in range(size_b.bit_length()):
        if size_b >> k & 1:
            a = _gf2_times(_MOVES[k], a)
    return a ^ b


def _join_pieces(batches):
    for b in batches:
        out = []
        for doc_id, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            found.sort(key=lambda x: x["nth"])
            if [x["nth"] for x in found] != list(range(len(found))) or not found[-1]["ends"]:
                raise ValueError(f"document {doc_id}: a block is missing")
            crc, n, ids = 0, 0, []
            for x in found:
                crc = join_crc32(crc, x["crc"], 4 * x["n"]) if n else x["crc"]
                n += x["n"]
                ids += x["ids"] or []
            out.append((found[0]["start"], n, crc, ids))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([x[0] for x in out], pa.int64()), b.column(1), pa.array([x[1] for x in out], pa.int64()),
             pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.list_(pa.int32()))],
            names=["part", "start", "doc_id", "n", "crc", "ids"])


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False, lanes: int = LANES) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every
    document in a folder of token files."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    found = blocks.mapInArrow(_read(lanes, with_ids), _PIECE_SCHEMA)
    found = materialize(found, "token-pieces")  # used twice
    one = F.col("ends") & (F.col("nth") == 0)
    whole = found.where(one).select("part", "start", "doc_id", "n", "crc", "ids")
    key = F.struct("nth", "start", "n", "crc", "ends", "ids")
    joined = _runs(found.where(~one)).groupBy("part", "doc_id", "run").agg(F.collect_list(key).alias("found"))
    joined = joined.select("part", "doc_id", "found").mapInArrow(
        _join_pieces, "part int, start long, doc_id long, n long, crc long, ids array<int>")
    total = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = total.select(F.col("part").alias("o_part"), F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("offset"))
    both = whole.unionByName(joined.select(whole.columns))
    out = both.join(offsets, both["part"] == offsets["o_part"])
    cols = [F.col("doc_id"), (F.col("offset") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"),
            F.col("crc").alias("ids_crc32")]
    return out.select(*cols, *(["ids"] if with_ids else []))


def _runs(pieces_: DataFrame) -> DataFrame:
    """Tells apart rows that repeat a doc_id in a part: the pieces of one
    document follow each other, so number the first pieces by place."""
    w = Window.partitionBy("part", "doc_id").orderBy("start")
    return pieces_.withColumn("run", F.sum(F.when(F.col("nth") == 0, 1).otherwise(0)).over(w))


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the documents' token files and reads them back."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_root(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer_path, folder, **options)
    return read_token_files(spark, folder)


def op3(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    import public_tokenizers

    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
