"""Search for parts of texts through an index of words and their places.

The index holds, for each word of the folded texts, where it begins in each document, in
buckets of words; and a list of all words with how often they stand. A term is looked up by
the words that it spells out: a word inside it must be the same, one at its edge need only
end or begin like it, and a term within one word may stand anywhere in it. Only places of the
term's rarest word are read, and each is held against the text, so the result is that
of a scan for the term.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold

WORD = re.compile(r"[^\W_]+")
BUCKETS, LEAST, AROUND = 64, 3, 160
#: Places that a worker gathers before it hands them on.
HELD = 50_000


def _places(batches):
    """Rows of word, id and places, few at a time: a long text's words may come in several."""
    for b in batches:
        kinds = [pa.string(), b.column(0).type, pa.list_(pa.int32())]

        def rows(words, ids, places, kinds=kinds):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((words, ids, places), kinds, strict=True)], names=["word", "id", "places"])

        words, ids, places, held = [], [], [], 0
        for k in range(b.num_rows):
            i, found = b.column(0)[k].as_py(), WORD.finditer(b.column(1)[k].as_py() or "")
            while at := _by_word(itertools.islice(found, HELD)):
                words += at
                places += at.values()
                ids += [i] * len(at)
                held += sum(map(len, at.values()))
                if held >= HELD:
                    yield rows(words, ids, places)
                    words, ids, places, held = [], [], [], 0
        yield rows(words, ids, places)


def _by_word(found) -> dict[str, list[int]]:
    at: dict[str, list[int]] = {}
    for m in found:
        at.setdefault(m[0], []).append(m.start() + 1)
    return at


class TextIndex:
    """An index in a folder; documents without an id are left out."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def build(self, docs: DataFrame, key: str, text: str) -> None:
        rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), fold(F.col(text)).alias("t"))
        kind = rows.schema["id"].dataType.simpleString()
        found = rows.mapInArrow(_places, f"word string, id {kind}, places array<int>").withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int"))
        # a frequent word's documents are dealt to several files
        dealt = found.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "word")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/places")
        self._postings().groupBy("bucket", "word").agg(F.sum(F.size("places")).alias("n")).write.mode("overwrite").parquet(f"{self.root}/words")

    def _postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/places")

    @staticmethod
    def _parts(term: str) -> list[tuple[str, str, int]]:
        """Words of the term: how a word of the text must meet each, the word, and where it stands in the term."""
        out = []
        for m in WORD.finditer(term):
            left, right = m.start() > 0, m.end() < len(term)
            out.append(("same" if left and right else "begins" if left else "ends" if right else "holds", m[0], m.start()))
        return out

    @staticmethod
    def _meets(kind: str, part: str) -> Column:
        w = F.col("word")
        return {"same": w == part, "begins": w.startswith(part), "ends": w.endswith(part), "holds": w.contains(part)}[kind]

    def _starts(self, term: str) -> DataFrame | None:
        """``id`` and ``starts``: where the term may begin; None if it has no word."""
        parts = self._parts(term)
        if not parts:
            return None
        words = self.spark.read.parquet(f"{self.root}/words")
        often = words.agg(*(F.sum(F.when(self._meets(k, p), F.col("n"))).alias(str(i)) for i, (k, p, _) in enumerate(parts))).first()
        kind, part, offset = parts[min(range(len(parts)), key=lambda i: often[i] or 0)]
        met = words.where(self._meets(kind, part)).select("bucket", "word")
        inside = {
            "same": F.array(F.lit(0)), "begins": F.array(F.lit(0)), "ends": F.array(F.length("word") - len(part)),
            "holds": F.filter(F.sequence(F.lit(0), F.length("word") - len(part)), lambda i: F.substring(F.col("word"), i + 1, F.lit(len(part))) == part),
        }[kind]
        starts = F.flatten(F.transform("places", lambda p: F.transform(inside, lambda i: p + i - offset)))
        return self._postings().where(self._meets(kind, part)).join(met, ["bucket", "word"]).select("id", F.explode(starts).alias("start")).where("start > 0").groupBy("id").agg(F.sort_array(F.collect_set("start")).alias("starts"))

    def search(self, docs: DataFrame, key: str, text: str, query: str, around: int = AROUND, most: int | None = None) -> DataFrame:
        """Hits of terms joined by OR: term, key, place, context, and how often the term was found; rarest terms first.

        Terms are folded and have ``LEAST`` characters at least. Hits of a term don't overlap,
        the first counts. ``most`` keeps the first hits in order of rarity, key and place.
        """
        terms = list(dict.fromkeys(t for raw in re.split(r"\s+OR\s+", query, flags=re.I) if (t := self._fold(raw.strip()))))
        if not terms or any(len(t) < LEAST for t in terms):
            raise ValueError(f"terms have {LEAST} characters at least")
        texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
        hits = []
        for term in terms:
            n, starts = len(term), self._starts(term)
            folded = texts.withColumn("folded", fold(F.col("text")))
            if starts is None:  # no word to look up: a scan
                at = folded.withColumn("starts", F.expr("sequence(1, greatest(1, length(folded)))")).where(F.contains("folded", F.lit(term)))
            else:
                at = folded.join(starts, "id")
            right = F.filter("starts", lambda s: F.substring(F.col("folded"), s, F.lit(n)) == term)
            if any(term.endswith(term[:k]) for k in range(1, n)):  # its places may overlap
                none = F.array().cast("array<int>")
                right = F.aggregate(right, none, lambda a, s: F.when(F.coalesce(F.try_element_at(a, F.lit(-1)) + n <= s, F.lit(True)), F.concat(a, F.array(s))).otherwise(a))
            rows = at.select("id", "text", F.explode(right).alias("at"))
            begin = F.greatest(F.lit(1), F.col("at") - around)
            context = F.regexp_replace(F.substring(F.col("text"), begin, F.col("at") + n + around - begin), r"\s+", " ")
            hits.append(rows.select(F.lit(term).alias("term"), F.col("id").alias(key), F.col("at").cast("bigint").alias("at"), context.alias("context")))
        found = reduce(DataFrame.unionByName, hits)
        often = found.groupBy("term").agg(F.count("*").alias("found"))  # a row for each term
        ranked = found.join(F.broadcast(often), "term")
        return ranked if most is None else ranked.orderBy("found", key, "at", "term").limit(most)

    def _fold(self, term: str) -> str:
        return self.spark.range(1).select(fold(F.lit(term))).first()[0]
