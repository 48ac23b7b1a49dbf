"""Token ids in compressed binary files.

Ids are coded by ``idcoder`` in blocks that are reset, checksummed and decoded each by
itself. Documents are range-sorted by id, each task writes the files of its range
under temporary names, and a manifest written last names the files in order.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens
from .common import binary_array, byte_list, new_path, release, resource, table, text_blocks, text_view, tidy, tune
from .idcoder import BLOCK_IDS, from_block, to_block
from .ranges import bounds, in_ranges
from .warc import file_system

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: Ids after which a file is closed; a document is never split.
FILE_IDS = 12_000_000
#: Bytes of text of one range of ids.
PART_BYTES = 16 << 20
#: Words whose ids a worker remembers; blocks that would go beyond keep theirs to themselves.
REMEMBERED = 700_000
MAGIC = b"IDMIX2\0\0"


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    # the byte-level alphabet: printable bytes stand for themselves, others from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = np.zeros(256, "<u4")
    letters[plain] = plain
    letters[letters == 0] = 256 + np.arange(256 - len(plain))
    return t, [x.content.encode() for x in t.get_added_tokens_decoder().values()], _Words(), letters


class _Words:
    """Words that a worker has met: their places in a list of ids."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, words: list[bytes], apply, letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, the ends of words in them, and the place of each of ``words``; unknown ones go through ``apply``."""
        at = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        fresh = [words[k] for k in new.tolist()]
        cut = np.cumsum([0, *map(len, fresh)]).tolist()
        line = letters[np.frombuffer(b"".join(fresh), np.uint8)].tobytes().decode("utf-32-le")
        found = [apply(line[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        at[new] = len(self.ends) - 1 + np.arange(len(new))
        ids = np.concatenate([self.ids, np.array([t.id for x in found for t in x], np.uint32)])
        ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([*map(len, found)], dtype=np.int64)])
        if len(self.place) + len(fresh) <= REMEMBERED:
            self.place.update(zip(fresh, at[new].tolist(), strict=True))
            self.ids, self.ends = ids, ends
        return ids, ends, at


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and their offsets, as the tokenizers library gives them.

    Each distinct word of the block goes through the library once; a text that holds
    a special token's string goes through it whole.
    """
    tok, special, known, letters = _tokenizer(path)
    data, docs = text_view(texts)
    raw = data.tobytes()
    whole = {}
    for s in special:
        at = raw.find(s)
        while at >= 0:
            d = int(np.searchsorted(docs, at, "right")) - 1
            if at + len(s) <= docs[d + 1]:
                whole[d] = tok.encode(raw[docs[d] : docs[d + 1]].decode(), add_special_tokens=False).ids
            at = raw.find(s, at + 1)
    at = pretokens.starts(data, docs)
    code = binary_array(data, np.append(at, len(data))).dictionary_encode()
    flat, off, place = known.encode(byte_list(code.dictionary), tok.model.tokenize, letters)
    lists = pa.LargeListArray.from_arrays(pa.array(off), pa.array(flat)).take(pa.array(place.take(code.indices.to_numpy(zero_copy_only=False))))
    ids, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    docs_at = ends[np.searchsorted(at, docs)]
    if whole:
        parts = [np.array(whole[d], np.uint32) if d in whole else ids[docs_at[d] : docs_at[d + 1]] for d in range(len(docs) - 1)]
        ids, docs_at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    return ids, docs_at


def to_file(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: magic, header length, zstd of the header, blocks. The header has the documents and each block's length."""
    n = -(-len(ids) // BLOCK_IDS)
    blocks = [to_block(x) for x in np.array_split(ids, n)] if n else []
    parts = [np.array([len(doc_ids), len(blocks)], "<i8"), np.array([x is None for x in doc_ids], "u1"), np.array([x or 0 for x in doc_ids], "<i8"), sizes.astype("<i8"), np.array([len(b) for b in blocks], "<i8")]
    head = zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts))
    return MAGIC + np.array([len(head), zlib.crc32(head)], "<u4").tobytes() + head + b"".join(blocks)


def from_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids in each document, and all ids; ValueError if a checksum is wrong."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of ids")
    size, checksum = np.frombuffer(data, "<u4", 2, 8).tolist()
    if zlib.crc32(data[16 : 16 + size]) != checksum:
        raise ValueError("checksum of the header")
    raw, at = zstandard.ZstdDecompressor().decompress(data[16 : 16 + size]), 0

    def take(kind, k):
        nonlocal at
        out = np.frombuffer(raw, kind, k, at)
        at += out.nbytes
        return out

    docs, blocks = take("<i8", 2).tolist()
    null, names, sizes, lengths = take("u1", docs), take("<i8", docs), take("<i8", docs), take("<i8", blocks)
    ends = 16 + size + np.concatenate([[0], np.cumsum(lengths)])
    ids = [from_block(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [None if x else int(v) for x, v in zip(null, names, strict=True)], sizes, np.concatenate([np.zeros(0, np.uint32), *ids])


def _writer(root: str, path: str, end_id: int, file_ids: int):
    def run(batches):
        fs, at = file_system(root)
        fs.create_dir(at, recursive=True)
        attempt, part = TaskContext.get().taskAttemptId(), None
        names, sizes, ids, held, n, done = [], [], [], 0, 0, []

        def close():
            nonlocal names, sizes, ids, held, n
            if names:
                release()  # what encoding held is not there beside the coder's tables
                data = to_file(names, np.concatenate(sizes), np.concatenate(ids))
                name = f"part-{part:06d}-{n:05d}.ids"
                temp = f"{at}/.{name}-{attempt}.tmp"
                with fs.open_output_stream(temp, compression=None) as f:
                    f.write(data)
                fs.move(temp, f"{at}/{name}")
                done.append((part, n, name, len(names), held, len(data)))
                names, sizes, ids, held, n = [], [], [], 0, n + 1

        for block in text_blocks(batches, "text", 6 << 20):
            parts = block.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if part != parts[a]:
                    close()
                    part, n = int(parts[a]), 0
                got, off = encode_texts(block.column("text").slice(a, b - a), path)
                names += block.column("doc_id").slice(a, b - a).to_pylist()
                got = np.insert(got, off[1:], end_id)
                sizes.append(np.diff(off) + 1)
                ids.append(got)
                held += len(got)
                if held >= file_ids:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["part", "roll", "file", "docs", "ids", "bytes"])

    return run


def write_ids(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS, part_bytes: int = PART_BYTES) -> str:
    """Encode texts and write their ids in ascending order of the id; gives the manifest's path.

    Null texts count as empty and give the end id alone. Null ids come first, rows of
    an equal id in the order of their texts. Other columns are not read. The files
    follow from the rows alone: another run or partitioning writes the same bytes.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    at = bounds(rows.withColumn("size", F.octet_length("text")), "doc_id", "tie", "size", part_bytes)
    ordered = in_ranges(rows, "doc_id", "tie", at, "part").sortWithinPartitions("part", "doc_id", "tie", "text")
    files = ordered.drop("tie").mapInArrow(tidy(_writer(root, path or resource(TOKENIZER), end_id, file_ids)), "part long, roll long, file string, docs long, ids long, bytes long")
    listed = sorted(files.collect(), key=lambda r: (r.part, r.roll))  # a row per file
    fs, at = file_system(root)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/.manifest.tmp") as f:
        f.write(json.dumps([{k: r[k] for k in ("file", "docs", "ids", "bytes")} for r in listed]).encode())
    fs.move(f"{at}/.manifest.tmp", f"{at}/manifest.json")
    return f"{at}/manifest.json"


def _each_file(spark: SparkSession, root: str, make, schema: str) -> DataFrame:
    """``make(doc_ids, starts, sizes, ids)`` gives a record batch of each file of the manifest."""
    fs, at = file_system(root)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        files = json.loads(f.read())
    base, rows = 0, []
    for x in files:
        rows.append((x["file"], base))
        base += x["ids"]

    def run(batches):
        fs, at = file_system(root)
        for b in batches:
            for name, first in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                with fs.open_input_stream(f"{at}/{name}", compression=None) as f:
                    names, sizes, ids = from_file(f.read())
                yield from make(names, first + np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes, ids)

    return spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows))).mapInArrow(tidy(run), schema)


def read_ids(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, start, ids`` of each document: ``start`` ids stand before it in all files."""

    def make(names, starts, sizes, ids):
        off = np.concatenate([[0], np.cumsum(sizes)])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "start", "ids"])

    return _each_file(spark, root, make, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files."""

    def make(names, starts, sizes, ids):
        raw, off = memoryview(ids.astype("<u4").tobytes()), (4 * np.concatenate([[0], np.cumsum(sizes)])).tolist()
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _each_file(spark, root, make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of ids hold of every document.

    Null and empty texts are the end id alone; very long ones are cut over blocks. Null ids
    come first, repeated ids follow one another, each with its own row. An empty table gives no rows.
    """
    root = new_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), root)
    return read_digests(spark, root)


QUERIES = {"op6_id_files": op6_id_files}
