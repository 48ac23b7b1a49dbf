"""Exact token counts at every prefix of a text, by dynamic programming.

A piece never continues past a word start, nor across a line or tab, so a text's
count is the sum over its segments. Within a segment the tokens of each prefix
follow from shorter ones: the last token of ``s[:i]`` is the piece ``p`` for which
``s[:i - len(p)]`` ends in a token that stays apart from ``p``; then
``count[i] = count[i - len(p)] + 1``. Truncation and budget questions read these
counts and never encode again. A worker keeps the counts of all prefixes of the
segments it has met; a text's cut at a budget is read from those of one segment.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import binary_array, byte_list, resource, spread, table, text_blocks, text_view, tidy, tune

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Segments whose counts a worker remembers; others are worked out again.
REMEMBERED = 400_000
STEP_BYTES = 8 << 20
_MARK = "▁"


class Counter:
    """Prefix counts of segments under one piece model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text as it is are supported")
        pieces = [p.piece for p in model.pieces if p.type == 1]
        if any(_MARK in p.lstrip(_MARK) or set(p) & {"\n", "\t"} and len(p) > 1 for p in pieces) or any(p.type == 4 for p in model.pieces):
            raise ValueError("pieces of this model run over segment ends")
        self.dummy = spec.add_dummy_prefix
        spec.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.longest = max(map(len, pieces))
        self.whole = {p for p in pieces if self.plain.encode(p, out_type=str) == [p]}
        self.apart: dict[tuple[str, str], bool] = {}
        self.stored: dict[bytes, bytes | list[int]] = {}

    def _apart(self, a: str, b: str) -> bool:
        got = self.apart.get((a, b))
        if got is None:
            got = a + b not in self.whole and self.plain.encode(a + b, out_type=str) == [a, b]
            if len(self.apart) < 2_000_000:
                self.apart[a, b] = got
        return got

    def prefixes(self, segment: str) -> list[int]:
        """Tokens of segment[:i] for each i from 0 on."""
        s = segment.replace(" ", _MARK)
        count, last, whole = [0], [""], self.whole
        for i in range(1, len(s) + 1):
            for j in range(max(0, i - self.longest), i):
                p = s[j:i]
                if p in whole and (not last[j] or self._apart(last[j], p)):
                    count.append(count[j] + 1)
                    last.append(p)
                    break
            else:  # no piece: its bytes, which never join others
                count.append(count[i - 1] + len(s[i - 1].encode()))
                last.append("")
        return count

    def counts(self, segment: bytes) -> bytes | list[int]:
        """The stored counts of all prefixes of a segment; worked out at its first use."""
        got = self.stored.get(segment)
        if got is None:
            got = self.prefixes(segment.decode())
            got = bytes(got) if max(got) < 256 else got
            if len(self.stored) < REMEMBERED:
                self.stored[segment] = got
        return got


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def segments(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Offsets where segments begin: texts, word starts, and both sides of lines and tabs."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    space = data == 0x20
    lead = np.flatnonzero(data == 0xE2)
    lead = lead[lead + 2 < n]
    lead = lead[(data[lead + 1] == 0x96) & (data[lead + 2] == 0x81)]
    tail = space.copy()
    space[lead], tail[lead + 2] = True, True
    hard = (data == 0x0A) | (data == 0x09)
    fresh = space | hard
    fresh[1:] = (space[1:] & ~tail[:-1]) | hard[1:] | hard[:-1]
    fresh[docs[:-1][docs[:-1] < n]] = True
    return np.flatnonzero(fresh)


def _prefixed(arr: pa.Array, dummy: bool) -> pa.Array:
    arr = pc.fill_null(arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr, "")
    if not dummy:
        return arr
    return pc.if_else(pc.equal(pc.binary_length(arr), 0), arr, pc.binary_join_element_wise(pa.scalar(" ", arr.type), arr, pa.scalar("", arr.type)))


def count_block(arr: pa.Array, path: str, budget: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text of a block, and the code points of its longest prefix with ``budget`` tokens at most (-1: the whole text).

    Each distinct segment is worked out once.
    """
    c = counter(path)
    data, docs = text_view(_prefixed(arr, c.dummy))
    at = segments(data, docs)
    code = binary_array(data, np.append(at, len(data))).dictionary_encode()
    each = np.array([c.counts(s)[-1] for s in byte_list(code.dictionary)] or [0], np.int64)
    sums = np.concatenate([[0], np.cumsum(each[code.indices.to_numpy(zero_copy_only=False)])])
    ends = np.searchsorted(at, docs)
    total, cut = np.diff(sums[ends]), np.full(len(arr), -1, np.int64)
    for d in np.flatnonzero(total > budget).tolist() if budget is not None else ():
        # counts never fall from one segment's start to the next: the cut lies in the last that starts within the budget
        a, b = ends[d], ends[d + 1]
        k = a + int(np.searchsorted(sums[a:b], sums[a] + budget, "right")) - 1
        left = budget - int(sums[k] - sums[a])
        segment = data[at[k] : at[k + 1] if k + 1 < len(at) else len(data)].tobytes()
        inside = max(i for i, n in enumerate(c.counts(segment)) if n <= left)
        before = int(((data[docs[d] : at[k]] & 0xC0) != 0x80).sum())  # code points
        cut[d] = max(0, before + inside - c.dummy)
    return total, cut


def token_count(text_col, path: str | None = None):
    """A column: the tokens of each text; 0 for null and empty texts."""
    return within_budget(text_col, None, path)["n_tokens"]


def within_budget(text_col, budget: int | None, path: str | None = None):
    """A struct column: ``n_tokens``, and ``prefix_chars``, the code points of the longest prefix with ``budget`` tokens at most.

    Null and empty texts have 0 of both. A text within the budget is its own prefix.
    """
    path = path or resource(MODEL)

    @arrow_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("cut", T.LongType())]))
    @tidy
    def count(texts: pa.Array) -> pa.Array:
        parts = [count_block(b.column("t"), path, budget) for b in text_blocks([pa.RecordBatch.from_arrays([texts], names=["t"])], "t", STEP_BYTES)]
        cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1)]
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], ["n_tokens", "cut"])

    text = F.col(text_col).cast("string")
    got = count(text)
    whole = F.coalesce(F.length(text), F.lit(0)).cast("long")
    return F.struct(got["n_tokens"].alias("n_tokens"), F.when(got["cut"] < 0, whole).otherwise(got["cut"]).alias("prefix_chars"))


def prefix_counts(docs: DataFrame, text_col: str = "text", out: str = "prefix_tokens", path: str | None = None) -> DataFrame:
    """``docs`` and ``out``: tokens of each prefix of the text by code points, from the empty one on.

    A null text counts as empty. Counts may fall as a prefix grows, when pieces merge.
    """
    path = path or resource(MODEL)
    tune(docs.sparkSession)

    @arrow_udf(T.ArrayType(T.IntegerType()))
    @tidy
    def run(texts: pa.Array) -> pa.Array:
        c, rows = counter(path), []
        for t in pc.fill_null(texts, "").to_pylist():
            raw = ((" " if c.dummy and t else "") + t).encode()
            at = [*segments(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist(), len(raw)]
            out_, base = [], 0
            for a, b in zip(at[:-1], at[1:], strict=True):
                p = c.prefixes(raw[a:b].decode())
                out_ += [base + x for x in p[1:]]
                base += p[-1]
            rows.append([0, *out_[1:]] if c.dummy and t else [0, *out_])
        return pa.array(rows, pa.list_(pa.int32()))

    return docs.withColumn(out, run(F.col(text_col).cast("string")))


def truncate_to(docs: DataFrame, budget: int, text_col: str = "text", prefix_col: str = "prefix_tokens", out: str = "truncated") -> DataFrame:
    """The longest prefix of each text with ``budget`` tokens at most, read from the stored counts."""
    last = F.array_max(F.transform(F.col(prefix_col), lambda n, i: F.when(n <= budget, i).otherwise(0)))
    return docs.withColumn(out, F.substring(F.coalesce(F.col(text_col), F.lit("")), F.lit(1), last.cast("int")))


def op10_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and its longest prefix within the limit.

    Null and empty texts have 0 of each; very long ones are counted whole, segment by
    segment. Repeated rows and ids get equal counts; an empty table gives no rows.
    """
    tune(spark)
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    got = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), within_budget("text", LIMIT).alias("b"))
    return got.select("doc_id", "n_bytes", F.col("b.n_tokens").alias("n_tokens"), (F.col("b.n_tokens") > LIMIT).alias("over_limit"), F.col("b.prefix_chars").alias("prefix_chars"))


QUERIES = {"op10_prefix_counts": op10_prefix_counts}
