"""Benchmark decontamination by winnowing.

Both sides keep, in each window of ``w`` consecutive k-grams, the smallest k-gram
hash (the last one at a tie). Two texts that share ``w + k - 1`` words share a
whole window, hence its smallest hash, so no shared span of that length is
missed. Fingerprints of documents are joined with those of the benchmark, and
each meeting is extended to the benchmark windows around it, which are compared by
64-bit hashes of all their words: of n document windows against m benchmark windows
about n m / 2^64 meet by chance (10^13 against 10^6: one in two). Items shorter than the window have their own, shorter guarantee.

A benchmark of at most ``broadcast_rows`` fingerprints and windows, counted first,
is sent to every task; a larger one is joined by shuffles. Results are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import cut, table, text_blocks, text_view, tidy, tune

WINDOW = 10
#: Rows of benchmark fingerprints and windows, 16 bytes each and the items' ids, that may be broadcast.
BROADCAST_ROWS = 2_000_000
#: Bytes of text that are held as arrays at a time; a longer document counts alone.
STEP_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and for each text the place of its first word (end included)."""
    low = _LOWER[data]
    inside = _WORD[low]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    cut_at = docs[:-1][docs[:-1] < len(data)]
    fresh[cut_at] = inside[cut_at]
    begin = np.flatnonzero(fresh)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(docs), np.int64)
    kept = np.flatnonzero(inside)
    first = np.searchsorted(kept, begin)
    size = np.diff(np.append(first, len(kept)))
    place = np.arange(len(kept)) - np.repeat(first, size)
    value = (low[kept].astype(np.uint64) + np.uint64(1)) * _powers(_M1, int(size.max()))[place]
    return _mix(np.add.reduceat(value, first)), np.searchsorted(begin, docs)


def grams(words: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """The hash of the k words from each place; places near the end are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, p = np.zeros(n, np.uint64), _powers(base, k)
    for j in range(k):
        out += words[j : j + n] * p[j]
    return _mix(out)


def split(length: int) -> tuple[int, int]:
    """k and w of the guarantee: k + w - 1 is ``length``."""
    k = (length + 1) // 2
    return k, length - k + 1


def inner(docs: np.ndarray, length: int, n: int) -> np.ndarray:
    """Whether the ``length`` words from each place lie in one text."""
    doc = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
    return doc[: n - length + 1] == doc[length - 1 :] if n >= length else np.zeros(0, bool)


def winnow(gram: np.ndarray, whole: np.ndarray, w: int) -> np.ndarray:
    """Places of the smallest gram of each whole window, the last at a tie."""
    start = np.flatnonzero(whole)
    if not len(start):
        return start
    best, at = gram[start], start.copy()
    for j in range(1, w):
        g = gram[start + j]
        less = g <= best
        best = np.where(less, g, best)
        at[less] = start[less] + j
    return np.unique(at)


def near(at: np.ndarray, whole: np.ndarray, w: int) -> np.ndarray:
    """Starts of the whole windows that hold one of the fingerprints at ``at``."""
    s = np.unique((at[:, None] - np.arange(w)[None, :]).ravel())
    s = s[(s >= 0) & (s < len(whole))]
    return s[whole[s]]


def find(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in the sorted ones, -1 if it isn't there."""
    if not len(sorted_values):
        return np.full(len(values), -1)
    p = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[p] == values, p, -1)


def benchmark_windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``length, kind, hash, item``: an item's windows (kind w) and winnowed fingerprints (kind f)."""

    def run(batches):
        for block in text_blocks(batches, "text", STEP_BYTES):
            data, off = text_view(block.column("text"))
            words, doc = word_hashes(data, off)
            items, out = block.column("item").to_pylist(), []
            for i, name in enumerate(items):
                own = words[doc[i] : doc[i + 1]]
                m = min(window, len(own))
                if not m:
                    continue
                k, w = split(m)
                whole = np.ones(len(own) - m + 1, bool)
                g = grams(own, k, _M1)
                out += [(m, "w", h, name) for h in set(grams(own, m, _M3).view(np.int64).tolist())]
                out += [(m, "f", h, None) for h in set(g[winnow(g, whole, w)].view(np.int64).tolist())]
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["length", "kind", "hash", "item"])

    rows = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "length int, kind string, hash long, item string").distinct()


class Index:
    """The benchmark as sorted arrays, by window length."""

    def __init__(self, rows: pa.Table):
        self.by = {}
        length, kind, value = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("length", "kind", "hash"))
        code = rows.column("item").combine_chunks()
        code = code.dictionary_encode() if not isinstance(code, pa.ChunkedArray) else code.combine_chunks().dictionary_encode()
        self.items = code.dictionary.to_pylist()
        item = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        for m in np.unique(length).tolist():
            f = np.unique(value[(length == m) & (kind == "f")].astype(np.int64).view(np.uint64))
            own = (length == m) & (kind == "w")
            h, i = value[own].astype(np.int64).view(np.uint64), item[own]
            order = np.argsort(h, kind="stable")
            w, first = np.unique(h[order], return_index=True)
            self.by[m] = (f, w, np.append(first, len(h)), i[order])


KIND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scan(texts: pa.Array, index: Index) -> list[tuple[int, int, list, list]]:
    """n_words, n_hit, hit spans of words, and items of each text."""
    data, off = text_view(texts)
    words, doc = word_hashes(data, off)
    n, found = len(words), []
    for m, (prints, windows, first, items) in index.by.items():
        k, w = split(m)
        whole = inner(doc, m, n)
        g = grams(words, k, _M1)
        at = winnow(g, whole, w)
        at = at[find(prints, g[at]) >= 0]
        if not len(at):
            continue
        s = near(at, whole, w)
        b = _powers(_M3, m)
        h = np.zeros(len(s), np.uint64)
        for j in range(m):
            h += words[s + j] * b[j]
        p = find(windows, _mix(h))
        s, p = s[p >= 0], p[p >= 0]
        found += [(a, a + m, items[first[q] : first[q + 1]]) for a, q in zip(s.tolist(), p.tolist(), strict=True)]
    spans, named = {}, {}
    if found:
        found.sort(key=lambda x: x[0])
        own = np.searchsorted(doc, [a for a, _, _ in found], "right") - 1
        for d, (a, b, its) in zip(own.tolist(), found, strict=True):
            at = spans.setdefault(d, [])
            if at and a <= at[-1][1]:
                at[-1][1] = max(at[-1][1], b)
            else:
                at.append([a, b])
            named.setdefault(d, set()).update(its.tolist())
    out = []
    for d, size in enumerate(np.diff(doc).tolist()):
        at = [{"start": a - int(doc[d]), "end": b - int(doc[d])} for a, b in spans.get(d, [])]
        out.append((size, sum(x["end"] - x["start"] for x in at), at, sorted(index.items[i] for i in named.get(d, ()))))
    return out


def _struct(rows) -> pa.Array:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], _SPANS), pa.array(cols[3], pa.list_(pa.string()))], ["n_words", "n_hit", "spans", "items"])


def _by_broadcast(docs: DataFrame, rows: DataFrame, text_col: str, out: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(Index(rows.toArrow()))

    @arrow_udf(KIND)
    @tidy
    def mark(texts: pa.Array) -> pa.Array:
        parts = []
        for b in text_blocks([pa.RecordBatch.from_arrays([texts], names=["t"])], "t", STEP_BYTES):
            parts += scan(b.column("t"), held.value)
        return _struct(parts)

    return docs.withColumn(out, mark(F.col(text_col).cast("string")))


def _by_shuffle(docs: DataFrame, rows: DataFrame, text_col: str, out: str, lengths: list[int]) -> DataFrame:
    key = next(c for c in (f"row{i}" for i in range(len(docs.columns) + 1)) if not any(x.startswith(c) for x in docs.columns))
    docs = cut(docs.withColumn(key, F.monotonically_increasing_id()), "decontam-docs")
    texts = docs.select(F.col(key).alias("row"), F.col(text_col).cast("string").alias("text"))

    def prints(batches):
        for block in text_blocks(batches, "text", STEP_BYTES):
            data, off = text_view(block.column("text"))
            words, doc = word_hashes(data, off)
            row = block.column("row").to_numpy()
            for m in lengths:
                k, w = split(m)
                g = grams(words, k, _M1)
                at = winnow(g, inner(doc, m, len(words)), w)
                own = np.searchsorted(doc, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(row[own]), pa.array(np.full(len(at), m, np.int32)), pa.array(g[at].view(np.int64)), pa.array((at - doc[own]).astype(np.int32))], names=["row", "length", "hash", "at"])

    def extend(batches):
        for b in batches:
            for i in range(b.num_rows):
                words, doc = word_hashes(*text_view(b.column("text").slice(i, 1)))
                met = {}
                for x in b.column("met")[i].as_py():
                    met.setdefault(x["length"], []).append(x["at"])
                for m, at in met.items():
                    s = near(np.array(at), inner(doc, m, len(words)), split(m)[1])
                    h = grams(words, m, _M3)[s].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column("row")[i].as_py()] * len(s), pa.int64()), pa.array([m] * len(s), pa.int32()), pa.array(h), pa.array(s.astype(np.int32))], names=["row", "length", "hash", "start"])

    met = texts.mapInArrow(tidy(prints), "row long, length int, hash long, at int").join(rows.where("kind = 'f'").select("length", "hash"), ["length", "hash"], "left_semi")
    met = met.groupBy("row").agg(F.collect_list(F.struct("length", "at")).alias("met"))
    hit = cut(met.join(texts, "row").select("row", "text", "met").mapInArrow(tidy(extend), "row long, length int, hash long, start int").join(rows.where("kind = 'w'").select("length", "hash", "item"), ["length", "hash"]).select("row", "start", (F.col("start") + F.col("length")).alias("end"), "item"), "decontam-hits")
    spans = hit.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("all"))
    merged = F.expr("""aggregate(all, cast(array() as array<struct<start:int,end:int>>), (a, x) ->
        case when size(a) > 0 and x.start <= element_at(a, -1).end
             then concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end))))
             else concat(a, array(x)) end)""")
    items = hit.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))

    @arrow_udf(T.LongType())
    def size(texts: pa.Array) -> pa.Array:
        return pa.array(np.diff(word_hashes(*text_view(texts))[1]))

    found = spans.withColumn("spans", merged).drop("all").join(items, "row").withColumnRenamed("row", key).select(key, F.struct("spans", "items").alias(f"{key}_found"))
    spans_or = F.coalesce(F.col(f"{key}_found.spans"), F.array().cast(KIND["spans"].dataType))
    items_or = F.coalesce(F.col(f"{key}_found.items"), F.array().cast("array<string>"))
    n_hit = F.aggregate(spans_or, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    made = docs.withColumn(f"{key}_size", size(F.col(text_col).cast("string"))).join(found, key, "left")
    made = made.withColumn(out, F.struct(F.col(f"{key}_size").alias("n_words"), n_hit.alias("n_hit"), spans_or.alias("spans"), items_or.alias("items")))
    return made.drop(f"{key}_size", f"{key}_found", key)


def contamination(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, out: str = "contamination", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` and a struct ``out``: n_words, n_hit, spans of hit words, ids of items found.

    A null or wordless text has no words and no hits. A null item id reads as an
    empty string; items of the same id count once. Every row of ``docs`` is kept.
    """
    tune(docs.sparkSession)
    rows = cut(benchmark_windows(bench, item_col, item_text_col, window), "benchmark-windows")
    if rows.count() <= broadcast_rows:
        return _by_broadcast(docs, rows, text_col, out)
    return _by_shuffle(docs, rows, text_col, out, [r.length for r in rows.select("length").distinct().collect()])


def decontaminate(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a hit, their columns unchanged."""
    name = next(c for c in (f"contamination{i or ''}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    return contamination(docs, bench, out=name, **options).where(F.col(name)["n_hit"] == 0).drop(name)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and met items of every document.

    Null and word-less texts hit nothing, nor do such items; very long texts are scanned
    whole. Repeated rows and ids get equal results, a row each; items of a repeated id count
    as one. An empty ``documents`` gives no rows, an empty ``benchmark`` no hits.
    """
    got = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return got.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array(c["items"]), ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT id, least(10, len(w)) AS m, w[k:k + least(10, len(w)) - 1] AS win FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(k) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, k, m, w[k:k + m - 1] AS win FROM d, ms, unnest(range(1, greatest(len(w) - m + 2, 1))) AS t(k)),
hit AS (SELECT r, k, m, id FROM dw JOIN iw USING (m, win)),
n AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM hit, unnest(range(0, m)) AS t(j) GROUP BY r),
it AS (SELECT r, count(DISTINCT id) AS n_items, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""

QUERIES = {"op3_decontamination": op3_decontamination}
ORACLES = {"op3_decontamination": SQL}
