import random

import duckdb
import pytest
import regex

from marlstone.llm import quality_rules as q

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(regex.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(many)


def texts():
    rng = random.Random(1)
    words = ["a", "bé", "c#", "漢字", "|", "WORD!", "e f", "x\x0by"]
    made = ["".join(rng.choice(words[: rng.randint(1, 8)]) + rng.choice([" ", "\n", "\t", "  ", "\r\n"]) for _ in range(rng.randint(0, 50))) for _ in range(150)]
    return [None, "", " \n\n ", "long" * 10000, "a b c d e " * 900, *made, made[-1]]


def test_counts_by_brute_force_and_sql(spark):
    rows = [(i if i != 3 else None, t, 1, 2) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, counts int, quality_counts int")
    got = q.apply_rules(df, out="verdict").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(r.verdict[c] for c in names) for r in got] == [brute(t) for _, t, _, _ in rows]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    want = con.sql(q.SQL).fetchall()
    key = lambda x: str(x)
    assert sorted([(r.doc_id, *(r.verdict[c] for c in (*names, "base_failed", "kept"))) for r in got], key=key) == sorted(want, key=key)
    assert q.keep_good(df).columns == df.columns


def test_order_and_empty(spark):
    df = spark.createDataFrame([("good words stand here in one line of eleven plain tokens",)], "text string")
    order = q.order_rules(df)
    assert {r.name for r, _, _ in order} == {r.name for r in q.RULES} and all(s >= 1e-3 for _, _, s in order)
    assert q.keep_good(df).count() == 1 and q.keep_good(df.limit(0)).count() == 0


def test_costly_rules_come_later(spark):
    """Of rules that reject alike the dear one is timed as such, whatever a job takes."""
    from pyspark.sql import functions as F

    dear = q.Rule("dear", lambda text, n: F.length(F.regexp_replace(F.repeat(text, 30), r"[aeiou]\\w*t", "")) < 0)
    cheap = q.Rule("cheap", lambda text, n: F.length(text) < 0)
    rows = spark.range(500).selectExpr("concat_ws(' ', transform(sequence(1, 400), i -> concat('word', cast(id * i as string)))) AS text")
    took = {r.name: s for r, _, s in q.order_rules(rows, (dear, cheap))}
    assert took["dear"] > 3 * took["cheap"]


def test_bullets_and_ellipses(spark):
    a, b = "these are ten plain words that stand in one line", "others of the same kind come after them in the next"
    texts = [f"- {a}\n\t* {b}", f"{a}\n- {b}", f"{a}...\n{b}", f"{a}.. \n{b}"]
    got = q.apply_rules(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r.quality.kept for r in got] == [False, True, False, True]


@pytest.mark.parametrize("sql", [q.SQL])
def test_sql_on_tables(spark, sf, sql):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = {tuple(r) for r in q.op4_quality_rules(spark, sf).collect()}
    assert got == set(con.sql(sql).fetchall())
