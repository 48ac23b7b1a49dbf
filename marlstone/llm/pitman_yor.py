"""A hierarchical Pitman-Yor language model of word pairs.

Each word is a context with a restaurant of its own; all share one parent, the
restaurant of single words, whose base is even over the words seen and one class for
all others. Seating is sampled by Gibbs steps in turn: given the parent's predictive
probabilities, the tables of each dish of each context; then, given these tables,
which are the parent's customers, the tables of each of the parent's dishes. A step
moves all customers of a dish at once, at every count (``seating``). Dishes of one
round are drawn side by side from the tables that the round before left. Two chains
run beside each other; a text's probability is the mean over their last rounds.

Texts are cut to blocks with a dictionary each. Words travel as sorted hashes and
pairs as sorted keys, once per block, to the task that owns their bucket; counts come
back in the same order. A frequent word or pair is one entry per block. One block
stands for each pair and draws its tables; rounds send sums by word, not pairs. At the
end tables go to the pairs' owners and from there to all blocks that have the pair.
Words are told apart by 64-bit hashes, pairs by 56-bit keys of their words' numbers.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_array, byte_list, crc_mod, cut, discard, table, text_blocks, text_view, tidy, tune
from .seating import Law

BLOCK_BYTES = 12 << 20
CHAINS, ROUNDS = 2, 3
#: Discount and concentration of contexts, and of their parent.
CONTEXT, PARENT = (0.85, 4.0), (0.6, 10.0)
END = b" "
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[0x20, 9, 10, 11, 12, 13]] = False


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd frame of byte planes."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], "<i8").tobytes()
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head + planes)


def load(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(raw[:8].view("<i8")[0])
    head, at, out = raw[8 : 8 + 16 * n].view("<i8").reshape(n, 2).tolist(), 8 + 16 * n, []
    for code, size in head:
        kind = np.dtype(chr(code))
        end = at + size * kind.itemsize
        out.append(np.ascontiguousarray(raw[at:end].reshape(kind.itemsize, size).T).view(kind).ravel() if size else np.zeros(0, kind))
        at = end
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted array; cumsum undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def small(x: np.ndarray) -> np.ndarray:
    """The least unsigned type that holds all values."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max))


@functools.cache
def law(discount: float) -> Law:
    return Law(discount)


def _cut_blocks(buckets: int):
    """A row of documents for each block, and a row of word hashes for each bucket in it.

    The block's words are numbered by bucket and hash; ``held`` marks texts that don't train.
    """

    def run(batches):
        part, n = (TaskContext.get().partitionId() if TaskContext.get() else 0), 0
        for block in text_blocks(batches, "text", BLOCK_BYTES):
            data, off = text_view(block.column("text"))
            inside = _WORD[data]
            fresh = inside.copy()
            fresh[1:] &= ~inside[:-1]
            cuts = off[:-1][off[:-1] < len(data)]
            fresh[cuts] = inside[cuts]
            begin, kept = np.flatnonzero(fresh), np.flatnonzero(inside)
            code = binary_array(_LOWER[data[kept]], np.append(np.searchsorted(kept, begin), len(kept))).dictionary_encode()
            doc = np.searchsorted(begin, off)
            seq = np.insert(code.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc[1:], len(code.dictionary))
            size = np.diff(doc) + 1
            held = block.column("held").to_numpy().astype(bool)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in [*byte_list(code.dictionary), END]], np.uint64)
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((hashes, bucket))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            seq = place[seq]
            counts = np.bincount(seq, weights=np.repeat(~held, size), minlength=len(order)).astype(np.int64)
            bucket, hashes = bucket[order], hashes[order]
            edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            rows = [dump(steps(hashes[a:b]), small(counts[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            rank = np.empty(len(order), np.int64)  # frequent words get small numbers
            by = np.argsort(-np.bincount(seq, minlength=len(order)), kind="stable")
            rank[by] = np.arange(len(order))
            own = block.column("doc_id").combine_chunks()
            k = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 33) | n] * (k + 1), pa.int64()),
                    pa.array([None, *bucket[edge[:-1]].tolist()], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0] + [block.num_rows] * (k + 1), pa.int32()), own),
                    pa.array([dump(small(rank[seq]), small(by), small(size), held.view(np.uint8)), *rows], pa.binary()),
                ],
                names=["block", "bucket", "doc_ids", "packed"],
            )
            n += 1

    return run


def _out(rows) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.int64()))], names=["block", "bucket", "packed", "totals"])


_ROWS = "block long, bucket int, packed binary, totals array<long>"


def _own_words(rows: pa.Table) -> pa.Table:
    """Number the words of a bucket and count them: each block gets back numbers and counts."""
    rows = rows.sort_by("block")
    parts = [load(x) for x in rows.column("packed").to_pylist()]
    hashes = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    every, at = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate([p[1] for p in parts]).astype(np.float64), minlength=len(every)).astype(np.int64)
    out, a = [], 0
    for k, (b, h) in enumerate(zip(rows.column("block").to_pylist(), hashes, strict=True)):
        own = at[a : a + len(h)]
        a += len(h)
        out.append((b, rows.column("bucket")[0].as_py(), dump(small(steps(own)), small(count[own])), None if k else [int(count.sum()), int((count > 0).sum())]))
    return _out(out)


class _Rows:
    """What came back to a block, by kind; the parts of a kind are in the order of buckets."""

    def __init__(self, rows: pa.Table):
        self.kinds = {}
        for kind in set(rows.column("kind").to_pylist()):
            some = rows.filter(pa.compute.equal(rows.column("kind"), kind)).sort_by("bucket")
            self.kinds[kind] = some.column("bucket").to_pylist(), [load(x) for x in some.column("packed").to_pylist()]
        if "words" in self.kinds:
            buckets, parts = self.kinds["words"]
            self.word_edges = np.cumsum([0, *(len(p[0]) for p in parts)])
            self.number = np.concatenate([(b << 36) + np.cumsum(p[0], dtype=np.int64) for b, p in zip(buckets, parts, strict=True)])
            self.count = np.concatenate([p[1].astype(np.int64) for p in parts])

    def back(self, kind: str, columns: int) -> list[np.ndarray]:
        parts = self.kinds[kind][1]
        return [np.concatenate([p[k].astype(np.int64) for p in parts]) for k in range(columns)]

    def parent(self, words: int, totals: list[int]):
        """Of each chain: probabilities of the words in the parent, and tables of their restaurants."""
        d, theta = PARENT
        got = self.back("parent", 3 * CHAINS)
        for s in range(CHAINS):
            customers, tables, context = got[3 * s : 3 * s + 3]
            all_customers, all_tables = totals[2 * s : 2 * s + 2]
            yield (customers - d * tables + (theta + d * all_tables) / (words + 1)) / (theta + all_customers), context


class _Block(_Rows):
    """A block's documents, and what came back about its words and pairs."""

    def __init__(self, rows: pa.Table, docs: pa.Table):
        super().__init__(rows)
        rank, by, size, held = load(docs.column("packed")[0].as_py())
        self.seq, self.size, self.held = by.astype(np.int64)[rank], size.astype(np.int64), held.astype(bool)
        ends = np.cumsum(self.size) - 1
        self.before = np.empty_like(self.seq)
        self.before[1:] = self.seq[:-1]
        self.before[np.concatenate([[0], ends[:-1] + 1])] = self.seq[ends[0]]  # a text begins after an end

    def pairs(self, buckets: int):
        """Distinct pairs by bucket and key: words, keys, training counts, and each token's pair."""
        n = len(self.number)
        code, at = np.unique(self.before * n + self.seq, return_inverse=True)
        train = np.bincount(at, weights=np.repeat(~self.held, self.size), minlength=len(code)).astype(np.int64)
        u, w = code // n, code % n
        k = self.number.astype(np.uint64)
        key = (k[u] * np.uint64(0x9E3779B97F4A7C15)) ^ (k[w] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key = (key ^ (key >> np.uint64(32))) >> np.uint64(8)
        bucket = (((key >> np.uint64(24)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)  # of the top 32 bits: no overflow
        order = np.argsort(key, kind="stable")  # by bucket too: buckets are ranges of keys
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return u[order], w[order], key[order], bucket[order], train[order], place[at]


def _send_pairs(buckets: int):
    """Keys of a block's pairs and their training counts."""

    def run(rows: pa.Table, docs: pa.Table) -> pa.Table:
        b = _Block(rows, docs)
        _, _, key, bucket, train, _ = b.pairs(buckets)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        name = docs.column("block")[0].as_py()
        return _out([(name, int(bucket[x]), dump(steps(key[x:y]), small(train[x:y])), None) for x, y in zip(edge[:-1], edge[1:], strict=True)])

    return run


def _own_pairs(rows: pa.Table) -> pa.Table:
    """Count the pairs of a bucket: each block gets whether it stands for the pair, counts, and places of pairs counted twice or more."""
    rows = rows.sort_by("block")
    parts = [load(x) for x in rows.column("packed").to_pylist()]
    keys = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    every, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    count = np.bincount(at, weights=np.concatenate([p[1] for p in parts]).astype(np.float64)).astype(np.int64)
    place = np.cumsum(count > 1) - 1
    stands = np.zeros(len(at), np.uint8)
    stands[first] = 1
    out, a, bucket = [], 0, rows.column("bucket")[0].as_py()
    for b, k in zip(rows.column("block").to_pylist(), keys, strict=True):
        own = slice(a, a + len(k))
        a += len(k)
        i = at[own]
        out.append((b, bucket, dump(stands[own], small(count[i]), small(steps(place[i[count[i] > 1]]))), None))
    return _out(out)


def _begin(buckets: int):
    """The pairs that a block stands for and that have a choice: words and counts; and the tables of those that have none."""

    def run(rows: pa.Table, docs: pa.Table) -> pa.Table:
        b = _Block(rows, docs)
        u, w, *_ = b.pairs(buckets)
        stands, count = b.back("pairs", 2)
        own, alone = np.flatnonzero((stands > 0) & (count > 1)), np.flatnonzero((stands > 0) & (count == 1))
        n = len(b.number)
        return _out([(docs.column("block")[0].as_py(), 0, dump(small(u[own]), small(w[own]), small(count[own]), small(np.bincount(w[alone], minlength=n)), small(np.bincount(u[alone], minlength=n))), None)])

    return run


def _round(k: int, tokens: int, words: int, totals: list[int] | None):
    """Draw the tables of a block's pairs; rows for the words' owners, and one without a bucket that keeps the tables."""

    def run(rows: pa.Table) -> pa.Table:
        b, name = _Rows(rows), rows.column("block")[0].as_py()
        u, w, count, alone_w, alone_u = (x.astype(np.int64) for x in b.kinds["state"][1][0])
        d, theta = CONTEXT
        if totals is None:  # a start: words by their counts, and about as many tables as such contexts have
            start = (b.count + 0.1) / (tokens + 0.1 * (words + 1)), np.ceil(b.count**0.9)
            given, had, parents = [start] * CHAINS, [np.ones(len(count), np.int64)] * CHAINS, [np.minimum(b.count, 1)] * CHAINS
        else:
            given, had, parents = list(b.parent(words, totals)), b.kinds["tables"][1][0], b.back("parent", 3 * CHAINS)[1::3]
        drawn, sums = [], []
        for s, ((p, context), old, parent) in enumerate(zip(given, had, parents, strict=True)):
            rng = np.random.default_rng([name, k, s])
            t = law(d).draw(count, np.maximum(context[u] - old.astype(np.int64), 0) + theta / d, p[w], rng)
            drawn.append(t)
            sums += [x + np.bincount(i, weights=t, minlength=len(x)).astype(np.int64) for x, i in ((alone_w, w), (alone_u, u))] + [parent]
        names, parts = b.kinds["words"]
        return _out([(name, None, dump(*map(small, drawn)), None), *((name, i, dump(p[0], *(small(x[a:z]) for x in sums)), None) for i, p, a, z in zip(names, parts, b.word_edges[:-1], b.word_edges[1:], strict=True))])

    return run


def _own_parent(k: int, words: int, totals: list[int] | None):
    def run(rows: pa.Table) -> pa.Table:
        """Draw the parent's tables of a bucket: each block gets customers, tables, and tables of its contexts."""
        rows = rows.sort_by("block")
        parts = [load(x) for x in rows.column("packed").to_pylist()]
        at = [np.cumsum(p[0], dtype=np.int64) for p in parts]
        flat = np.concatenate(at)
        n, bucket = int(flat.max()) + 1, rows.column("bucket")[0].as_py()
        d, theta = PARENT
        found, told = [], []
        for s in range(CHAINS):
            dish, context = (np.bincount(flat, weights=np.concatenate([p[1 + 3 * s + j] for p in parts]).astype(np.float64), minlength=n).astype(np.int64) for j in (0, 1))
            old = np.zeros(n, np.int64)
            old[flat] = np.concatenate([p[3 + 3 * s] for p in parts])
            all_tables = totals[2 * s + 1] if totals else words
            rng = np.random.default_rng([bucket, k, s, 1])
            tables = law(d).draw(dish, np.maximum(all_tables - old, 0) + theta / d, np.full(n, 1 / (words + 1)), rng)
            found += [dish, tables, context]
            told += [int(dish.sum()), int(tables.sum())]
        return _out([(b, bucket, dump(*(small(x[i]) for x in found)), None if j else told) for j, (b, i) in enumerate(zip(rows.column("block").to_pylist(), at, strict=True))])

    return run


def _send_seats(rows: pa.Table) -> pa.Table:
    """Places of a block's pairs with a choice, which of them it stands for, and the tables of these."""
    b, out, a = _Rows(rows), [], 0
    tables = b.kinds["tables"][1][0]
    for bucket, (stands, count, place) in zip(*b.kinds["pairs"], strict=True):
        own = stands[count > 1]
        z = a + int(own.sum())
        out.append((rows.column("block")[0].as_py(), bucket, dump(place, own, *(small(t[a:z]) for t in tables)), None))
        a = z
    return _out(out)


def _own_seats(rows: pa.Table) -> pa.Table:
    """Tables of a bucket's pairs with a choice: each block gets those of its own."""
    parts = [load(x) for x in rows.column("packed").to_pylist()]
    places = [np.cumsum(p[0], dtype=np.int64) for p in parts]
    seats = np.zeros((CHAINS, 1 + max((int(x[-1]) for x in places if len(x)), default=0)), np.int64)
    for p, x in zip(parts, places, strict=True):
        seats[:, x[p[1] > 0]] = p[2:]
    bucket = rows.column("bucket")[0].as_py()
    return _out([(b, bucket, dump(*(small(t[x]) for t in seats)), None) for b, x in zip(rows.column("block").to_pylist(), places, strict=True)])


def _score(buckets: int, tokens: int, words: int, totals: list[int]):
    def run(rows: pa.Table, docs: pa.Table) -> pa.Table:
        b = _Block(rows, docs)
        u, w, _, _, _, pair = b.pairs(buckets)
        _, count = b.back("pairs", 2)
        d, theta = CONTEXT
        p = np.zeros(len(u))
        for (parent, context), seats in zip(b.parent(words, totals), b.back("seats", CHAINS), strict=True):
            tables = np.minimum(count, 1)
            tables[count > 1] = seats
            own = count - d * tables + (theta + d * context[u]) * parent[w]
            p += np.where(b.count[u] > 0, own / (theta + b.count[u]), parent[w]) / CHAINS
        base = np.log10((b.count + 0.1) / (tokens + 0.1 * (words + 1)))
        starts = np.concatenate([[0], np.cumsum(b.size)[:-1]])
        total = lambda x: np.add.reduceat(x, starts)
        return pa.table([docs.column("doc_ids")[0].values, pa.array(b.held), pa.array(b.size), pa.array(total((b.count[b.seq] > 0).astype(np.int64))), pa.array(np.full(len(starts), tokens)), pa.array(total(base[b.seq])), pa.array(total(np.log10(p)[pair]))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    ``held_out``: a column that is true for rows that must not train. A null or empty
    text is its end alone. Repeated rows count as often as they occur. Where nothing
    trains every word falls in the class of unseen ones.
    """
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(True)).cast("int").alias("held"))
    buckets = max(32, min(65_536, 2 * rows.rdd.getNumPartitions()))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("packed", T.BinaryType())])
    blocks = cut(rows.mapInArrow(tidy(_cut_blocks(buckets)), schema), "py-blocks")
    own = blocks.where("bucket is null").select("block", "doc_ids", "packed")

    def named(df: DataFrame, kind: str) -> DataFrame:
        return df.select("block", "bucket", "packed", F.lit(kind).alias("kind"))

    def union(*parts: DataFrame) -> DataFrame:
        return functools.reduce(DataFrame.union, parts)

    def meet(run, out, *parts: DataFrame) -> DataFrame:
        """``run`` on each block's rows and its documents."""
        return union(*parts).groupBy("block").cogroup(own.groupBy("block")).applyInArrow(tidy(run), out)

    def by(column: str, run, rows: DataFrame, label: str = "") -> DataFrame:
        got = rows.groupBy(column).applyInArrow(tidy(run), _ROWS)
        return cut(got, label) if label else got

    def sums(df: DataFrame, n: int) -> list[int]:
        got = df.where("totals is not null").agg(*(F.sum(F.col("totals")[k]) for k in range(n))).first()
        return [int(x or 0) for x in got]

    words = by("bucket", _own_words, blocks.where("bucket is not null").select("block", "bucket", "packed"), "py-words")
    tokens, distinct = sums(words, 2)
    pair_buckets, words_named = 4 * buckets, named(words, "words")
    pairs = named(by("bucket", _own_pairs, meet(_send_pairs(pair_buckets), _ROWS, words_named), "py-pairs"), "pairs")
    begun = cut(meet(_begin(pair_buckets), _ROWS, words_named, pairs), "py-state")
    state, last = named(begun, "state"), ()
    totals, parent, tables = None, [], []
    for k in range(ROUNDS):
        drawn = by("block", _round(k, tokens, distinct, totals), union(words_named, state, *parent, *tables), "py-drawn")
        seated = by("bucket", _own_parent(k, distinct, totals), drawn.where("bucket is not null"), "py-parent")
        totals, parent, tables = sums(seated, 2 * CHAINS), [named(seated, "parent")], [named(drawn.where("bucket is null"), "tables")]
        discard(*last)
        last = drawn, seated
    discard(begun)
    seats = named(by("bucket", _own_seats, by("block", _send_seats, union(pairs, *tables)), "py-seats"), "seats")
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return meet(_score(pair_buckets, tokens, distinct, totals), out, words_named, pairs, *parent, seats)


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those not held out.

    Null and empty texts hold the end alone; very long ones are blocks of their own. Copies
    get equal scores; rows of a repeated or null id keep a row each, a null id counting
    as the empty text for the fold. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, crc_mod("doc_id", 10) == 0)


QUERIES = {"op7_pitman_yor": op7_pitman_yor}
