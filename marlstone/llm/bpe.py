"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut to pre-tokens in blocks of bounded size. A block keeps, for each
document, the sequence of its pre-tokens as places in the block's dictionary;
only the dictionary's words travel. They are shuffled in buckets of the word's
hash, so that each distinct word meets one task, is encoded there once, and its
ids go back to each block that holds it, where documents are put together by
position. A very frequent word is one word per block, never one per occurrence.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .common import binary_array, byte_list, resource, table, text_blocks, text_view, tidy, tune

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Ranks by frequency in a block at which the next tier of its dictionary begins.
TIERS = (255, 4096)
#: Bytes of text in a block: the larger, the fewer words are held by several blocks.
BLOCK_BYTES = 12 << 20


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@functools.cache
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def token_bytes(path: str) -> pa.Array:
    """The token-byte table: the bytes of each id; its size is the vocabulary's."""
    by = {i: b for b, i in ranks(path).items()}
    return pa.array([by.get(i, b"") for i in range(max(by) + 1)], pa.large_binary())


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as zstd of their byte planes."""
    return zstandard.ZstdCompressor(level=3).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[offsets[r]:offsets[r+1]] of each row one after another, and where each begins."""
    size = (offsets[1:] - offsets[:-1])[rows]
    at = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(at[-1]) + np.repeat(offsets[rows] - at[:-1], size)
    return values[take], at


def pack_words(words: list[bytes]) -> bytes:
    """Words as one zstd frame: their number and lengths, then their bytes."""
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at = (4 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)])).tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def pack_places(places: np.ndarray) -> bytes:
    """Places with one byte for the most frequent words and four planes for others."""
    rare = places >= TIERS[0]
    return zstandard.ZstdCompressor(level=3).compress(np.where(rare, 255, places).astype(np.uint8).tobytes() + places[rare].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_places(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out = raw[:n].astype(np.uint32)
    out[raw[:n] == 255] = np.ascontiguousarray(raw[n:].reshape(4, -1).T).view("<u4").ravel()
    return out


def _cut_blocks(buckets: int):
    """A row with the block's documents, and rows of its distinct pre-tokens by tier and bucket.

    The dictionary is ordered by tier, bucket and word, so a place in it needs no number on the way.
    """

    def run(batches):
        part, n = (TaskContext.get().partitionId() if TaskContext.get() else 0), 0
        for block in text_blocks(batches, "text", BLOCK_BYTES):
            data, off = text_view(block.column("text"))
            at = pretokens.starts_by_steps(data, off)
            code = binary_array(data, np.append(at, len(data))).dictionary_encode()
            seq, words = code.indices.to_numpy(zero_copy_only=False), code.dictionary
            size = np.diff(np.searchsorted(at, off))
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")] = np.arange(len(words))
            bucket = np.array([zlib.crc32(w) for w in byte_list(words)], np.int64) % buckets
            group = np.searchsorted(TIERS, rank, "right") * buckets + bucket
            order = pc.sort_indices(words).to_numpy().astype(np.int64)
            order = order[np.argsort(group[order], kind="stable")]
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words))
            group, words = group[order], byte_list(words.take(pa.array(order)))
            edge = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else [0]
            packed = [pack_words(words[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            own = block.column("doc_id").combine_chunks()
            ids = pa.ListArray.from_arrays(pa.array([0] + [block.num_rows] * (len(packed) + 1), pa.int32()), own)
            first = [int(group[a]) for a in edge[:-1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 33) | n] * (len(packed) + 1), pa.int64()),
                    pa.array([None, *(x // buckets for x in first)], pa.int32()),
                    pa.array([None, *(x % buckets for x in first)], pa.int32()),
                    ids,
                    pa.array([size.astype(np.int32).tolist()] + [None] * len(packed), pa.list_(pa.int32())),
                    pa.array([pack_places(place[seq]), *packed], pa.binary()),
                ],
                names=["block", "tier", "bucket", "doc_ids", "sizes", "packed"],
            )
            n += 1

    return run


def _encode_words(path: str):
    """Puts ids in place of packed words. Rows of a bucket come one after another; each word is encoded once."""

    def run(batches):
        enc, bucket, known = _encoder(path), None, {}
        for batch in batches:
            sizes, ids = [], []
            for k, data, own in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                if k is None:
                    sizes.append(own)
                    ids.append(data)
                    continue
                if k != bucket:
                    bucket, known = k, {}
                made = []
                for w in unpack_words(data):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = np.array(enc._encode_single_piece(w), "<u4").tobytes()
                    made.append(got)
                sizes.append(None)
                ids.append(pack(np.concatenate([[len(made)], np.array([len(x) // 4 for x in made]), np.frombuffer(b"".join(made), "<u4")])))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("block", "tier", "bucket", "doc_ids")] + [pa.array(sizes, pa.list_(pa.int32())), pa.array(ids, pa.binary())], names=batch.schema.names)

    return run


def _assemble(rows: pa.Table) -> pa.Table:
    """The ids of a block's documents, by position."""
    docs = rows.filter(pc.is_null(rows.column("bucket")))
    words = rows.filter(pc.is_valid(rows.column("bucket"))).sort_by([("tier", "ascending"), ("bucket", "ascending")])
    parts = [unpack(x) for x in words.column("packed").to_pylist()]
    size = np.concatenate([x[1 : x[0] + 1] for x in parts] or [np.zeros(0, np.uint32)])
    ids = np.concatenate([x[x[0] + 1 :] for x in parts] or [np.zeros(0, np.uint32)])
    off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    each = np.array(docs.column("sizes")[0].as_py(), np.int64)
    flat, at = ragged(ids, off, unpack_places(docs.column("packed")[0].as_py(), int(each.sum())))
    ends = at[np.concatenate([[0], np.cumsum(each)])]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
    return pa.table({"doc_id": docs.column("doc_ids")[0].values, "ids": lists})


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of each row; a null or empty text has no ids.

    Every row gives one row, repeated rows and null ids included; other columns
    of ``docs`` are not read, whatever their names.
    """
    path = vocabulary or resource(RANKS)
    spark = docs.sparkSession
    tune(spark)
    kind = docs.schema[id_col].dataType
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = max(64, min(65_536, 4 * held.rdd.getNumPartitions()))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("tier", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("packed", T.BinaryType())])
    # a partition for each bucket, so that none gets several; blocks' own rows are dealt among them
    place = F.coalesce("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int"))
    blocks = held.mapInArrow(tidy(_cut_blocks(buckets)), schema).repartitionById(buckets, place).sortWithinPartitions("bucket")
    coded = blocks.mapInArrow(tidy(_encode_words(path)), schema)
    return coded.groupBy("block").applyInArrow(tidy(_assemble), T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _lists(arr) -> tuple[np.ndarray, np.ndarray]:
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    off = arr.offsets.to_numpy().astype(np.int64)
    return arr.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]


def decode_ids(ids: pa.Array, path: str) -> pa.Array:
    """The bytes of each list of ids, looked up in the token-byte table."""
    flat, off = _lists(ids)
    data, at = text_view(pc.take(token_bytes(path), pa.array(flat)))
    return binary_array(data, at[off])


def bpe_decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and ``bytes`` of each row of ``ids``. An empty or null list gives empty bytes."""
    path = vocabulary or resource(RANKS)
    tune(tokens.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), decode_ids(pc.if_else(pc.is_null(b.column(1)), pa.scalar([], b.column(1).type), b.column(1)) if b.column(1).null_count else b.column(1), path).cast(pa.binary())], names=["doc_id", "bytes"])

    schema = T.StructType([T.StructField("doc_id", tokens.schema[id_col].dataType), T.StructField("bytes", T.BinaryType())])
    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(tidy(run), schema)


def token_digests(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Counts and digests of ids and of the bytes that they decode to."""
    path = vocabulary or resource(RANKS)
    tune(tokens.sparkSession)

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            flat, off = _lists(ids)
            text, at = text_view(decode_ids(ids, path))
            said = [hashlib.sha256(",".join(map(str, flat[x:y].tolist())).encode()).hexdigest() for x, y in zip(off[:-1], off[1:], strict=True)]
            back = [hashlib.sha256(text[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), pa.array(said), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField("doc_id", tokens.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return tokens.mapInArrow(tidy(run), schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids of every document and of the bytes they decode to.

    Null and empty texts have no ids; very long ones are blocks of their own. Repeated rows
    and ids get equal results, a row each; an empty table gives no rows.
    """
    return token_digests(bpe_encode(table(spark, sf_dir, "documents")))


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
