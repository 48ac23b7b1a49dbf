"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base counts come first. The other rules run as one nested condition that stops at
the first rejection. Their order comes from a sample, judged by all rules in one job: what
each takes by the clock, and which rows it rejects that the rules before it leave. The
order changes the cost only; a document is kept if no rule rejects it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table

#: Expected rows of the sample from which costs and rejections are estimated.
SAMPLE_ROWS = 2000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """``fails``: from the text and the struct of base counts, whether a document is rejected."""

    name: str
    fails: Callable[[Column, Column], Column]


def _share(text: Column, pattern: str) -> Column:
    """Characters of the text that ``pattern`` matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


RULES = (
    Rule("many symbols", lambda text, n: n["n_symbols"] > 0.1 * n["n_words"]),
    Rule("word length", lambda text, n: ~(n["word_chars"] / n["n_words"]).between(2.0, 15.0)),
    Rule("repeated lines", lambda text, n: n["n_dup_lines"] > 0.5 * n["n_lines"]),
    Rule("exclamations", lambda text, n: _share(text, "!+") > 0.1 * n["n_words"]),
    Rule("capitals", lambda text, n: _share(text, r"\p{Lu}+") > 0.3 * n["word_chars"]),
    Rule("bullets", lambda text, n: F.regexp_count(F.concat(F.lit("\n"), text), F.lit("\n[ \t]*[-*•]")) > 0.9 * n["n_lines"]),
    Rule("ellipses", lambda text, n: F.regexp_count(F.concat(text, F.lit("\n")), F.lit(r"(?:\.\.\.|…)[ \t]*\n")) > 0.3 * n["n_lines"]),
    Rule("few letters", lambda text, n: _share(text, r"\p{L}+") < 0.4 * n["word_chars"]),
)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with a number after it if columns of ``df`` begin like it."""
    return next(c for c in (f"{name}{i or ''}" for i in range(len(df.columns) + 1)) if not any(x.lower().startswith(c) for x in df.columns))


def base_counts(docs: DataFrame, text_col: str = "text", out: str = "counts") -> DataFrame:
    """``docs`` and a struct ``out`` of counts; null texts count as empty.

    5-word windows are compared by 64-bit hashes within one text.
    """
    t = free_name(docs, "quality_tmp")
    text, words, grams, ordered, lines = (f"{t}_{x}" for x in ("text", "words", "grams", "ordered", "lines"))
    keep = docs.columns
    at = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    at = at.withColumn(words, F.array_remove(F.split(text, SPACE), "")).withColumn(lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w = F.col(words)
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5))))
    at = at.select(*keep, text, words, lines, F.when(F.size(w) >= 5, windows).otherwise(F.array().cast("array<bigint>")).alias(grams))
    g = F.col(grams)
    twice = F.size(F.array_distinct(g)) < F.size(g)
    at = at.select(*keep, text, words, lines, F.when(twice, F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias(ordered))
    o = F.col(ordered)
    same = lambda a, b: F.coalesce(F.get(o, a)["h"] == F.get(o, b)["h"], F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
    places = F.sort_array(F.transform(found, lambda j: F.get(o, j)["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct((p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"])
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _share(F.col(text), SYMBOLS).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(o.isNull(), F.lit(0).cast("long")).otherwise(covered).alias("n_repeat_words"),
    )
    # The partition's number keeps filters on the counts above this projection: pushed
    # below it, they would take in the sorted windows once per element.
    return at.select(*keep, F.when(F.spark_partition_id() >= 0, counts).alias(out))


def base_failed(n: Column) -> Column:
    return (n["n_words"] < 10) | (100 * n["n_repeat_words"] > 20 * n["n_words"])


def _tick() -> Column:
    """Nanoseconds of the machine's clock."""
    return F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")


def order_rules(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """The rules by rejection per cost, with rejected share and seconds a million rows on the sample.

    One job judges each sampled row by all rules, with the clock between them: a rule's
    cost is the mean time between, less that between two readings, a nanosecond at least.
    Each next rule is that which rejects most, of the rows the ones before leave, for its cost.
    """
    n = free_name(docs, "counts")
    part = docs.sample(fraction=min(1.0, sample_rows / max(1, docs.count())), seed=seed)
    held = base_counts(part.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "text", n)
    judged = [x for k, r in enumerate(rules) for x in (F.coalesce(r.fails(F.col("text"), F.col(n)), F.lit(False)).alias(f"r{k}"), _tick().alias(f"t{k + 2}"))]
    marks = held.where(~base_failed(F.col(n))).select(F.struct(_tick().alias("t0"), _tick().alias("t1"), *judged).alias("m"))
    took = lambda k: F.sum(F.col(f"m.t{k + 1}") - F.col(f"m.t{k}")).alias(f"s{k}")
    verdicts = F.array(*(F.col(f"m.r{k}") for k in range(len(rules)))).alias("verdicts")
    groups = marks.groupBy(verdicts).agg(F.count("*").alias("rows"), *(took(k) for k in range(len(rules) + 1))).collect()  # a row for each combination at most
    total = max(1, sum(g["rows"] for g in groups))
    idle = sum(g["s0"] for g in groups)
    cost = [max(1e-3, (sum(g[f"s{k + 1}"] for g in groups) - idle) / total / 1e3) for k in range(len(rules))]
    out, left = [], list(range(len(rules)))
    while left:
        passed = [g for g in groups if not any(g["verdicts"][k] for k in range(len(rules)) if k not in left)]
        rejected = {k: sum(g["rows"] for g in passed if g["verdicts"][k]) for k in left}
        best = max(left, key=lambda k: (rejected[k] / cost[k], -cost[k]))
        out.append((rules[best], sum(g["rows"] for g in groups if g["verdicts"][best]) / total, cost[best]))
        left.remove(best)
    return out


def apply_rules(docs: DataFrame, text_col: str = "text", out: str = "quality", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` and a struct ``out``: base counts, base_failed, kept.

    Every row is judged by itself: repeated rows get the same verdict, a null or
    empty text fails the base. Other columns pass unchanged, whatever their names.
    """
    order = order_rules(docs, rules, text_col, sample_rows)
    n = free_name(docs, "quality_counts")
    text, counts = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(n)
    kept = F.when(base_failed(counts), False)
    for rule, _, _ in order:
        kept = kept.when(F.coalesce(rule.fails(text, counts), F.lit(False)), False)
    return base_counts(docs, text_col, n).select(*docs.columns, F.struct(*(counts[c].alias(c) for c in COUNTS), base_failed(counts).alias("base_failed"), kept.otherwise(True).alias("kept")).alias(out))


def keep_good(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, their columns unchanged."""
    name = free_name(docs, "quality_verdict")
    return apply_rules(docs, text_col, name, **options).where(F.col(name)["kept"]).select(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document.

    Null, empty and word-less texts have no words and fail the base; very long ones are
    judged whole. Repeated rows and ids get equal verdicts; an empty table gives no rows.
    """
    got = apply_rules(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return got.select("doc_id", *(F.col("quality")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
c AS (SELECT *, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
g AS (SELECT r, i, words[i:i + 4] AS gram FROM c, unnest(range(1, greatest(n_words - 3, 1)::BIGINT)) AS u(i)),
d AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM d, range(0, 5) AS s(k) GROUP BY r),
b AS (SELECT c.*, coalesce(p.n, 0) AS n_repeat_words FROM c LEFT JOIN p USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND NOT (n_symbols > 0.1 * n_words OR word_chars / n_words NOT BETWEEN 2.0 AND 15.0
        OR n_dup_lines > 0.5 * n_lines
        OR length(text) - length(regexp_replace(text, '!', '', 'g')) > 0.1 * n_words
        OR length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) > 0.3 * word_chars
        OR len(regexp_extract_all(concat(chr(10), text), '\n[ \t]*[-*•]')) > 0.9 * n_lines
        OR len(regexp_extract_all(concat(text, chr(10)), '(?:\.\.\.|…)[ \t]*\n')) > 0.3 * n_lines
        OR length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) < 0.4 * word_chars) AS kept
FROM f
"""

QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES = {"op4_quality_rules": SQL}
