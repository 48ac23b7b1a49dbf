"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints come from 4-word shingles. Equal ones are first made one row. Bits that
go together are grouped into partitions; each partition has its own threshold
``t``, -1 to leave it out, and the thresholds plus one add up to ``tau + 1``, so two
fingerprints at ``tau`` bits or fewer meet within the threshold of some partition.
Partitions and thresholds come from a dynamic programme on rows to send and pairs to
verify, estimated on a sample; any choice finds every link. Probes are verified in
the task that holds their bucket, which gives back a spanning forest of the links,
never all pairs. Buckets of many fingerprints are split again by their other bits, and
what stays large is cut to blocks of bounded size.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import cut, discard, table, tidy, tune

BITS, TAU, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints from which pairs are estimated; nothing else depends on the sample.
SAMPLE = 2048
#: Fingerprints of a bucket that one task compares at a time.
CHUNK = 1024
#: Shingles whose bits are held at a time.
STEP = 200_000


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text; 0 without words. Bits set in over half the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    end = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    last = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip(end[:n], end[last:], strict=False)), np.uint64, n)
    total = np.zeros(BITS, np.int64)
    for a in range(0, n, STEP):
        total += np.unpackbits(hashes[a : a + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


@arrow_udf(T.LongType())
@tidy
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def probes(self) -> np.ndarray:
        """What to flip in a key to reach all keys within the threshold, itself first."""
        flips = [c for t in range(self.threshold + 1) for c in itertools.combinations(self.bits, t)]
        return np.array([sum(1 << b for b in c) for c in flips], np.uint64)


def group_bits(sample: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits in groups of like size: each takes the bits that go most with those it has."""
    x = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    x -= x.mean(axis=0)
    scale = np.sqrt((x * x).sum(axis=0))
    like = np.abs(x.T @ x) / np.maximum(np.outer(scale, scale), 1e-9)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = (len(left) + parts - k - 1) // (parts - k)
        own = [max(sorted(left), key=lambda b: like[b, sorted(left)].sum())]
        left.discard(own[0])
        while len(own) < size:
            b = max(sorted(left), key=lambda c: like[c, own].sum())
            own.append(b)
            left.discard(b)
        out.append(tuple(sorted(own)))
    return out


def plan(sample: np.ndarray, n: int, tau: int = TAU, row_cost: float = 1.0, pair_cost: float = 0.01) -> list[Part]:
    """Partitions and thresholds of least cost for ``n`` distinct fingerprints."""
    sample = np.ascontiguousarray(sample, np.uint64)
    best, chosen = math.inf, []
    for m in range(2, tau + 2):
        groups = group_bits(sample, m) if len(sample) > 1 else [tuple(range(i, BITS, m)) for i in range(m)]
        costs = []
        for bits in groups:
            key = sample & np.uint64(sum(1 << b for b in bits))
            far = np.bitwise_count(key[:, None] ^ key[None, :])
            seen = [(far <= t).sum() - len(key) for t in range(tau)]
            of = {-1: 0.0}
            for t in range(min(tau, 3)):
                probes = sum(math.comb(len(bits), j) for j in range(t + 1))
                share = max(seen[t] / max(1, len(key) * (len(key) - 1)), probes / 2.0 ** len(bits))
                of[t] = row_cost * n * (1 + (probes if t else 0)) + pair_cost * share * n * n / 2
            costs.append(of)
        # state: thresholds plus one given out so far -> cost and choice
        state = {0: (0.0, ())}
        for of in costs:
            step: dict[int, tuple[float, tuple]] = {}
            for done, (c, way) in state.items():
                for t, more in of.items():
                    k = done + t + 1
                    if k <= tau + 1 and (k not in step or c + more < step[k][0]):
                        step[k] = (c + more, (*way, t))
            state = step
        if tau + 1 in state and state[tau + 1][0] < best:
            best, way = state[tau + 1]
            chosen = [Part(b, t) for b, t in zip(groups, way, strict=True) if t >= 0]
    return chosen


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, by hooking and pointer jumping."""
    lab = np.arange(n)
    while True:
        la, lb = lab[a], lab[b]
        if (la == lb).all():
            return lab
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while not ((up := lab[lab]) == lab).all():
            lab = up


def _links(data: np.ndarray, query: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two lists of fingerprints, block by block."""
    nodes, place = np.unique(np.concatenate([data, query]), return_inverse=True)
    d, q = place[: len(data)], place[len(data) :]
    every_a, every_b = [], []
    for i in range(0, len(query), 256):
        r, c = np.nonzero(np.bitwise_count(query[i : i + 256, None] ^ data[None, :]) <= tau)
        a, b = q[i + r], d[c]
        lab = forest(a, b, len(nodes))
        own = np.flatnonzero(lab != np.arange(len(nodes)))
        every_a.append(own)
        every_b.append(lab[own])
    a, b = np.concatenate(every_a), np.concatenate(every_b)
    lab = forest(a, b, len(nodes))
    own = np.flatnonzero(lab != np.arange(len(nodes)))
    return nodes[own], nodes[lab[own]]


def _verify(tau: int):
    """Links of each bucket. Rows are sorted by bucket; a bucket may go on in the next batch."""

    def run(batches):
        left = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = {c: batch.column(c).to_numpy() for c in ("part", "key", "sub", "subkey", "row", "col", "query", "fp")}
                left = now if left is None else {c: np.concatenate([left[c], now[c]]) for c in now}
            if left is None or not len(left["fp"]):
                continue
            fresh = np.ones(len(left["fp"]), bool)
            fresh[1:] = np.logical_or.reduce([left[c][1:] != left[c][:-1] for c in ("part", "key", "sub", "subkey", "row", "col")])
            begin = np.flatnonzero(fresh)
            stop = begin[-1] if batch is not None else len(fresh)
            begin = begin[begin < stop]
            if len(begin):
                size = np.diff(np.append(begin, stop))
                fp, query, both = left["fp"].view(np.uint64), left["query"], [[], []]
                for s, k in zip(begin[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                    of, x = query[s : s + k], fp[s : s + k]
                    d, q = x[of != 1], x[of != 0]
                    if len(d) and len(q):
                        if len(d) * len(q) <= 4:  # most buckets
                            for u in q.tolist():
                                for v in d.tolist():
                                    if u != v and (u ^ v).bit_count() <= tau:
                                        both[0].append(u), both[1].append(v)
                        else:
                            a, b = _links(d, q, tau)
                            both[0] += a.tolist()
                            both[1] += b.tolist()
                if both[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in both], schema=schema)
            left = {c: v[stop:] for c, v in left.items()}

    return run


def _probe(parts: list[Part]):
    """Rows (part, key, query, fp): 0 to be found, 1 to look, 2 both."""

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for i, p in enumerate(parts):
                key = fp & np.uint64(p.mask)
                for j, flip in enumerate(p.probes()):
                    n = len(fp)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array((key ^ flip).view(np.int64)), pa.array(np.full(n, 1 if j else 2, np.int32)), b.column("fp")], names=["part", "key", "query", "fp"])

    return run


def other_bits(part: Part, tau: int) -> list[int]:
    """Masks of ``tau`` + 1 groups of the bits that a part leaves out, as signed numbers."""
    rest = [b for b in range(BITS) if b not in part.bits]
    masks = [sum(1 << b for b in rest[i :: tau + 1]) for i in range(tau + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _cut_large(rows: DataFrame, here: list[str], chunk: int, label: str) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` and whether their bucket has over ``chunk`` fingerprints, and the large buckets with their blocks, if there are any."""
    large = cut(rows.where("query != 1").groupBy(*here).count().where(F.col("count") > chunk), label)
    n = large.count()  # rows / chunk at most
    if not n:
        return rows.withColumn("large", F.lit(False)), None
    large = large.withColumn("blocks", F.ceil(F.col("count") / chunk).cast("int")).drop("count")
    named = large.select(*here, F.lit(True).alias("_large"))
    at = rows.join(F.broadcast(named) if n <= 100_000 else named, here, "left")
    return at.withColumn("large", F.coalesce("_large", F.lit(False))).drop("_large"), large


def _in_blocks(rows: DataFrame, large: DataFrame, here: list[str]) -> DataFrame:
    """Rows of buckets that stay large: each block of data meets each block of queries."""
    at = rows.join(large, here)
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_data = F.transform(F.filter(others, lambda x: F.col("query") != 1), lambda x: F.struct(x.alias("row"), mine.alias("col"), F.lit(0).alias("query")))
    as_query = F.transform(F.filter(others, lambda x: F.col("query") != 0), lambda x: F.struct(mine.alias("row"), x.alias("col"), F.lit(1).alias("query")))
    return at.select(*here, "fp", F.explode(F.concat(as_data, as_query)).alias("x")).select(*here, "x.row", "x.col", "x.query", "fp")


def links(prints: DataFrame, tau: int = TAU, sample_rows: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` at ``tau`` bits or fewer: a forest that joins what they join."""
    spark = prints.sparkSession
    n = prints.count()
    few = prints.where(F.pmod(F.xxhash64(F.lit(1), "fp"), F.lit(max(1, n // sample_rows))) == 0).limit(4 * sample_rows)
    parts = plan(np.array([r.fp for r in few.select("fp").collect()], np.int64).view(np.uint64), n, tau)
    rows = prints.select("fp").mapInArrow(tidy(_probe(parts)), "part int, key long, query int, fp long")
    here = ["part", "key"]
    rows, large = _cut_large(rows, here, chunk, "simhash-large")
    if large is not None:
        # in a large bucket two fingerprints at tau bits agree on one of tau + 1 groups of its other bits
        masks = F.create_map(*(x for i, p in enumerate(parts) for x in (F.lit(i), F.array(*(F.lit(m) for m in other_bits(p, tau))))))
        split = F.posexplode(F.transform(masks[F.col("part")], lambda m: F.col("fp").bitwiseAND(m))).alias("sub", "subkey")
        hot = rows.where("large").select("part", "key", "query", "fp", split)
        cold = rows.where("not large").select("part", "key", "query", "fp", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subkey"))
        here = [*here, "sub", "subkey"]
        hot, still = _cut_large(hot, here, chunk, "simhash-larger")
        zero = [F.lit(0).alias("row"), F.lit(0).alias("col")]
        alone = lambda df: df.select(*here, *zero, "query", "fp")
        rows = alone(cold).unionByName(alone(hot) if still is None else alone(hot.where("not large")).unionByName(_in_blocks(hot.where("large"), still, here)))
    else:
        rows = rows.select("part", "key", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subkey"), F.lit(0).alias("row"), F.lit(0).alias("col"), "query", "fp")
    bucket = ["part", "key", "sub", "subkey", "row", "col"]
    rows = rows.repartition(*bucket).sortWithinPartitions(*bucket)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    return rows.mapInArrow(tidy(_verify(tau)), "a long, b long")


def with_one(rows: DataFrame, ones: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``ones``, which has one row for each ``key`` and in ``count`` how many rows meet it.

    Keys that meet a thousandth of all rows are 1000 at most: they are broadcast, so
    that no task gets a hub's rows. The others meet in a shuffle.
    """
    total = ones.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * 1000 > total
    hubs = ones.where(heavy).withColumnsRenamed({c: f"hub_{c}" for c in ones.columns})
    mixed = rows.join(F.broadcast(hubs), F.col(key) == F.col(f"hub_{key}"), "left")
    light = mixed.where(F.col(f"hub_{key}").isNull()).select(*rows.columns).join(ones.where(~heavy), key)
    out = [*rows.columns, *(c for c in ones.columns if c != key)]
    return mixed.where(F.col(f"hub_{key}").isNotNull()).select(*rows.columns, *(F.col(f"hub_{c}").alias(c) for c in ones.columns if c != key)).union(light.select(*out))


def roots(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, root`` of each node of the edges ``a, b``: the least node of its component.

    Large-star and small-star steps in turn until every edge leads to a root; each
    round is a table in the shared folder, and the one before is deleted.
    """

    def mins(e: DataFrame) -> DataFrame:
        return cut(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "star-mins")

    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = mins(both)
        large = with_one(both, least.select("u", F.least("u", "m").alias("m"), "n"), "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large, "star")
        least_large = mins(large)
        small = with_one(large, least_large, "u", "n")
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct()
        new = cut(small, "star")
        discard(now, least, large, least_large)
        # done when no node has two parents and no parent has one
        if new.groupBy("u").count().where("count > 1").isEmpty() and new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = new
    raise RuntimeError(f"components not settled after {rounds} rounds")


def _components(docs: DataFrame, id_col: str, text_col: str, tau: int, **more) -> DataFrame:
    """``doc_id``, the columns ``more``, ``fp, component_id`` and the component's ``root`` fingerprint of each row."""
    tune(docs.sparkSession)
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in more.items()), fingerprints(F.col(text_col).cast("string")).alias("fp")), "simhash-fp")
    groups = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "simhash-groups")
    of = roots(links(groups.select("fp"), tau))
    named = groups.join(of, groups.fp == of.node, "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root"))
    named = cut(named, "simhash-named")
    least = cut(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints")), "simhash-least")
    labels = cut(with_one(named, least, "root", "prints").select("fp", "rows", "component_id", "root"), "simhash-labels")
    found = with_one(rows, labels.select("fp", F.col("rows").alias("met"), "component_id", "root"), "fp", "met")
    return found.select(*rows.columns, "component_id", "root")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """``doc_id, fp, component_id`` of each row of ``docs``.

    The component's id is its least non-null doc_id (null if it has none). Null,
    empty and wordless texts share fingerprint 0 and link like any others. Repeated
    rows stay; columns other than id and text are not read.
    """
    return _components(docs, id_col, text_col, tau).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """One row of each component, that of the least id, null last (of repeated ids, the first by all columns).

    Rows are found again by id and text, which always stand in one component; an id
    alone may stand in several, and null stands in any number.
    """
    key = {f"text_{k}": F.xxhash64(F.lit(k), F.col(text_col).cast("string")) for k in (1, 2)}
    ids = _components(docs, id_col, text_col, tau, **key)
    least = ids.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", *key).agg(F.count("*").alias("n"))
    least = cut(least, "simhash-least")
    rows = least.groupBy("root").agg(F.sum("n").alias("kept_rows"))
    kept = cut(least.drop("n").join(rows.hint("shuffle_hash"), "root"), "simhash-kept").withColumnsRenamed({c: f"kept_{c}" for c in ("root", "doc_id", *key)})
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("k.kept_doc_id"))
    for k, c in key.items():
        same &= F.xxhash64(F.lit(int(k[-1])), F.col(f"d.{text_col}").cast("string")) == F.col(f"k.kept_{k}")
    # joined by a shuffle at every size, so that few documents are not treated unlike many
    of = lambda rows, how: docs.alias("d").join(rows.alias("k").hint("shuffle_hash"), same, how)
    once, more = kept.where("kept_rows = 1"), kept.where("kept_rows > 1")
    if more.isEmpty():
        return of(once, "left_semi")
    row = F.struct(*(F.col(f"d.{c}") for c in docs.columns))
    first = of(more, "inner").groupBy("k.kept_root").agg(F.min(row).alias("kept_row"))
    return of(once, "left_semi").unionByName(first.select("kept_row.*"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    Texts without words, null ones too, have fingerprint zero and link like any other; very
    long ones count whole. Copies share a fingerprint and so a component; rows of a
    repeated or null id keep a row each. An empty table gives no rows.
    """
    got = components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_components": op9_simhash_components}
