"""Token ids in binary files.

Format: Parquet files in ascending document order, one row per document:
``doc_id``, ``n_ids``, ``control``, ``data`` and the number of the file's range
``part``; beside them a table ``ranks`` (rank, id). Ids are replaced by their
frequency rank over the whole corpus, so that most take one byte. A value
takes 1 to 4 bytes, little-endian, in ``data``; its length less one takes two
bits in ``control``, four values to a byte, the first in the lowest bits. The
reader looks each control byte up in a table of 256 x 4 lengths, sums these to
the places of the values, and gathers the bytes.

Tokens come from the tokenizers library. Its splitter drops white space and
never joins letters, digits and punctuation in one token (but for an apostrophe
and the letters after it), and its normaliser folds case. So a block is cut at
white space and between ASCII or Latin-1 letters, digits and ASCII punctuation,
pieces equal but for case are folded, and each different piece is encoded once.
Pieces of ASCII and Latin-1 letters alone are one word to the splitter: many go
to the library's model at once, in lower case and as the byte characters of its
vocabulary, between spaces; their last tokens are those that end a word. Where
a text names a special token, it is only cut at white space. Special tokens are
not added; the end id is appended to every document.

Scale: texts are read once and not shuffled. The ids go to the shared folder,
in two bytes where the vocabulary allows, their frequencies are counted there
(at most one row per vocabulary entry leaves a task), and the documents are
dealt by ranges of document ids and coded behind that shuffle, as Spark runs
all that stands before a range shuffle twice (once to find the ranges).
The starts are sums inside each range plus the totals of the ranges before.

Null and empty texts have the end id only. Rows that repeat a document id stay
apart, next to each other; rows without an id come first. Empty tables give
empty files. Further columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import blocks as B
from .pieces import Pieces, gather
from .store import shared_folder

VOCABULARY = "word_bpe_49k.json"
END = 2
BLOCK = 8 << 20
CACHE = 600_000
#: Letter pieces that go to the library as one text.
TOGETHER = 256

#: Bytes: white space, letters, digits, punctuation, and those that stay with what is beside them.
_SPACE, _LETTER, _DIGIT, _PUNCTUATION, _BESIDE = range(5)
_KINDS = np.array([_SPACE if b in (9, 10, 11, 12, 13, 32) else _BESIDE if b > 127 or b < 32 or b in (39, 127) else _DIGIT if 48 <= b < 58 else _LETTER if chr(b).isalpha() else _PUNCTUATION for b in range(256)], np.uint8)
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
#: Codes to hash: as they are, and with ASCII letters in lower case.
_RAW = np.arange(256, dtype=np.uint8)
_RAW[0] = 255
_FOLDED = _RAW.copy()
_FOLDED[65:91] += 32

#: Lengths of the four values of each control byte.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, control bytes of each row, data bytes, data bytes of each row)."""
    values = values.astype("<u4")
    length = 1 + (values >= 1 << 8).astype(np.int64) + (values >= 1 << 16) + (values >= 1 << 24)
    control_size = (counts + 3) // 4
    first = np.cumsum(control_size) - control_size
    ends = np.cumsum(counts)
    codes = np.zeros(int(control_size.sum()) * 4, np.uint8)
    codes[np.arange(len(values)) + np.repeat(first * 4 - (ends - counts), counts)] = length - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    total = np.concatenate([[0], np.cumsum(length)])
    return control, control_size, data, np.diff(total[np.concatenate([[0], ends])])


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Values of many rows from their joined bytes."""
    control_size = (counts + 3) // 4
    length = _LENGTHS[control].ravel()
    first = np.cumsum(control_size) - control_size
    ends = np.cumsum(counts)
    length = length[np.arange(int(counts.sum())) + np.repeat(first * 4 - (ends - counts), counts)]
    at = np.cumsum(length) - length
    out = np.zeros(len(length), np.uint32)
    for b in range(4):
        has = length > b
        out[has] |= data[at[has] + b].astype(np.uint32) << np.uint32(8 * b)
    return out


#: The vocabulary's characters for bytes; those without a visible one have their own from 256 on, but space and line end stay.
_OWN = [*range(33), *range(127, 161), 173]
_CHARACTERS = np.arange(256, dtype="<u4")
_CHARACTERS[_OWN] = 256 + np.arange(len(_OWN))
_CHARACTERS[[10, 32]] = 10, 32
_ENDING = "</w>"


def _letters(path: str):
    """(the library's model behind a split at spaces, whether each id ends a
    word), or None if the file's model doesn't mark the ends of words."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        kind = json.load(file)
    model = kind["model"]
    own = [chr(_CHARACTERS[b]) for b in (*range(97, 123), 0xC3, *range(0x9F, 0xC0))]
    if model.get("end_of_word_suffix") != _ENDING or not all(c in model["vocab"] and c + _ENDING in model["vocab"] for c in own):
        return None
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[i for token, i in model["vocab"].items() if token.endswith(_ENDING)]] = True
    kind |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
    return Tokenizer.from_str(json.dumps(kind)), ends


_WORDS: dict[str, tuple] = {}


def _tools(path: str) -> tuple:
    """(tokenizer, that of letter pieces, words met) of this worker process."""
    if path not in _WORDS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _WORDS[path] = Tokenizer.from_file(path), _letters(path), Pieces(CACHE)
    return _WORDS[path]


def _kinds(block: np.ndarray) -> np.ndarray:
    kind = _KINDS[block]
    # the Latin-1 letters: C3 and any byte but those of the two signs among them
    lead = np.flatnonzero(block[:-1] == 0xC3)
    lead = lead[(block[lead + 1] != 0x97) & (block[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def cut(block: np.ndarray, limits: np.ndarray, fine: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the pieces of a block; no token reaches over their limits."""
    if not len(block):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _kinds(block)
    edge = np.ones(len(block) + 1, bool)
    left, right = kind[:-1], kind[1:]
    apart = (left == _SPACE) | (right == _SPACE)
    edge[1:-1] = apart | ((left != right) & (left != _BESIDE) & (right != _BESIDE)) if fine else apart
    edge[limits] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    text = kind[start] != _SPACE
    return start[text], end[text]


def _letter_ids(data: np.ndarray, size: np.ndarray, letters: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their number in each piece) of joined pieces of letters alone."""
    tokenizer, ends = letters
    spaced = np.full(len(data) + len(size), 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
    spaced[(np.cumsum(size) + np.arange(len(size)))[TOGETHER - 1 :: TOGETHER]] = 10
    lower = np.frombuffer(spaced.tobytes().decode().lower().encode(), np.uint8)
    found = tokenizer.encode_batch_fast(_CHARACTERS[lower].tobytes().decode("utf-32-le").split("\n"), add_special_tokens=False)
    ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
    return ids, np.diff(np.flatnonzero(ends[ids]), prepend=-1)


def _encode(block: np.ndarray, start: np.ndarray, end: np.ndarray, tokenizer, letters: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, their number in each piece, the order of the pieces) of block[start:end]."""
    size = end - start
    data = gather(block, start, size)
    alone = np.add.reduceat(_kinds(data) != _LETTER, np.cumsum(size) - size, dtype=np.int64) == 0 if letters else np.zeros(len(size), bool)
    own, rest = np.flatnonzero(alone), np.flatnonzero(~alone)
    ids, count = _letter_ids(data[np.repeat(alone, size)], size[own], letters) if len(own) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    raw = block.tobytes() if len(rest) else b""
    found = [e.ids for e in tokenizer.encode_batch([raw[s:e].decode() for s, e in zip(start[rest].tolist(), end[rest].tolist())], add_special_tokens=False)]
    more = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.concatenate([ids, np.fromiter((i for x in found for i in x), np.int32, int(more.sum()))])
    return ids, np.concatenate([count, more]), np.concatenate([own, rest])


def block_ids(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, limits of the rows) of rows lo..hi, without end ids."""
    tokenizer, letters, pieces = _tools(path)
    block = data[int(offsets[lo]) : int(offsets[hi])]
    raw = block.tobytes()
    plain = not any(x in raw for x in _SPECIAL)
    start, end = cut(block, offsets[lo : hi + 1] - offsets[lo], plain)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(hi - lo + 1, np.int64)
    h = B.span_hashes((_FOLDED if plain else _RAW)[block], start, end)
    h = h if plain else B.mix(h + np.uint64(1))  # apart from the folded pieces
    coded = pa.array(h).dictionary_encode()
    distinct, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    at = pieces.places(distinct)
    new = np.flatnonzero(at < 0)
    if len(new):
        first = np.empty(len(distinct), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        first = first[new]
        found, count, order = _encode(block, start[first], end[first], tokenizer, letters)
        at[new[order]] = pieces.add(distinct[new[order]], found, count)
    ids, ends = pieces.fill(at[which])
    return ids, ends[np.searchsorted(start, offsets[lo : hi + 1] - offsets[lo])]


def _with_end(ids: np.ndarray, limits: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    rows = len(limits) - 1
    out = np.full(len(ids) + rows, end, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(limits))] = ids
    return out, limits + np.arange(rows + 1)


def _binary(raw: bytes, ends: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())


def _bytes(column) -> np.ndarray:
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)


def _width(path: str | None = None, end: int = END, **_) -> int:
    """Bytes that hold every id of the vocabulary."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY)).get_vocab(with_added_tokens=True)
    return 2 if max(end, max(vocabulary.values())) < 1 << 16 else 4


def tokenized(docs: DataFrame, *, doc_id="doc_id", text="text", path: str | None = None, end: int = END, width: int = 4) -> DataFrame:
    """(doc_id, n_ids, ids): ids as little-endian integers of ``width`` bytes (2 or 4), the end id last."""
    path = path or public_tokenizers.path(VOCABULARY)
    key_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_bytes(batch.column(1))
            for lo, hi in B.row_blocks(offsets, BLOCK):
                ids, limits = _with_end(*block_ids(data, offsets, lo, hi, path), end)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(limits)), _binary(ids.astype(f"<u{width}").tobytes(), limits * width)], names=["doc_id", "n_ids", "ids"])

    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, f"doc_id {key_type}, n_ids bigint, ids binary")


def _frequencies(ids: DataFrame, width: int = 4) -> list[tuple[int, int]]:
    """(id, count), most frequent first; one row per vocabulary entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            seen = np.bincount(_bytes(batch.column(0)).view(f"<u{width}"))
            if len(seen) > len(total):
                total = np.pad(total, (0, len(seen) - len(total)))
            total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return sorted(((r["id"], r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def write_ids(docs: DataFrame, folder: str, **options) -> None:
    """Write the documents' ids under ``folder``: tables ``ids`` and ``ranks``."""
    spark = docs.sparkSession
    raw, width = f"{folder}/tokenized", _width(**options)
    ids = tokenized(docs, width=width, **options)
    ids.write.option("compression", "zstd").parquet(raw)
    ids = spark.read.schema(ids.schema).parquet(raw)
    order = [i for i, _ in _frequencies(ids, width)]
    spark.createDataFrame(list(enumerate(order)), "rank int, id int").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order))
    sent = spark.sparkContext.broadcast(rank)
    key_type = ids.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                counts = part.column(1).to_numpy(zero_copy_only=False)
                control, n_control, data, n_data = pack(sent.value[_bytes(part.column(2)).view(f"<u{width}")], counts)
                limits = lambda n: np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _binary(control.tobytes(), limits(n_control)), _binary(data.tobytes(), limits(n_data))], names=["doc_id", "n_ids", "control", "data"])

    dealt = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    coded = dealt.mapInArrow(run, f"doc_id {key_type}, n_ids bigint, control binary, data binary")
    coded.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{folder}/ids")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, part, n_ids, ids) of files written by ``write_ids``; ids as array<int>."""
    return _read(spark, folder, "ids array<int>", lambda ids, limits: pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(ids.astype(np.int32))))


def _crcs(ids: np.ndarray, limits: np.ndarray) -> pa.Array:
    raw = ids.astype("<u4").tobytes()
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())], pa.int64())


def _read(spark: SparkSession, folder: str, column: str, make) -> DataFrame:
    files = spark.read.parquet(f"{folder}/ids")
    order = np.array([r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], np.int64)
    sent = spark.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                counts = part.column(2).to_numpy(zero_copy_only=False)
                ids = sent.value[unpack(_bytes(part.column(3)), _bytes(part.column(4)), counts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), make(ids, np.concatenate([[0], np.cumsum(counts)]))], names=["doc_id", "part", "n_ids", column.split()[0]])

    return files.select("doc_id", "part", "n_ids", "control", "data").mapInArrow(run, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, part int, n_ids bigint, {column}")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    rows = _read(spark, folder, "ids_crc32 bigint", _crcs)
    # totals of the ranges before each range: a row per range
    totals = spark.read.parquet(f"{folder}/ids").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("doc_id", "ids_crc32", "n_ids").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return own.join(before, F.col("part") == F.col("_part")).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
