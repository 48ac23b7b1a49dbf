import random

import pytest
import regex

from marlstone.llm import decontam

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, bench):
    windows = {}
    for item, t in bench:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item) if item is not None else "")
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in windows:
                    hit |= {*range(i, i + k)}
                    items |= windows[x]
        out.append((d, len(w), len(hit), tuple(sorted(items))))
    return out


def cases():
    rng = random.Random(4)
    vocab = ["a", "Bé", "c1", "漢字", "ß", "dd", "e"]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 9, 10, 14, 25])))) for i in range(12)]
    bench += [(None, "q w"), (90, None), (91, ""), (92, "..."), (3, bench[4][1])]
    docs = [(None, "q W"), (1, None), (2, ""), (3, "...")]
    for i in range(4, 60):
        parts = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            src = words(rng.choice(bench)[1])
            a = rng.randint(0, max(0, len(src) - 1))
            parts += src[a : a + rng.randint(5, 20)]
        docs.append((i, rng.choice([" ", "\n", " - "]).join(parts).upper() if i % 3 else " ".join(parts)))
    return docs + docs[-2:], bench


@pytest.mark.parametrize("rows", [10**6, 0])
def test_against_brute_force(spark, rows):
    docs, bench = cases()
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, row0 int, hash int").repartition(3)
    got = decontam.contamination(df, spark.createDataFrame(bench, "item_id long, text string"), broadcast_rows=rows)
    key = lambda x: (x[0] is None, x)
    rows_ = [(r.doc_id, r.contamination.n_words, r.contamination.n_hit, tuple(r.contamination["items"])) for r in got.collect()]
    assert sorted(rows_, key=lambda x: str(x)) == sorted(brute(docs, bench), key=lambda x: str(x))
    assert all(sum(s.end - s.start for s in r.contamination.spans) == r.contamination.n_hit for r in got.collect())
    kept = decontam.decontaminate(df, spark.createDataFrame(bench, "item_id long, text string"), broadcast_rows=rows)
    assert kept.columns == df.columns and kept.count() == sum(x[2] == 0 for x in brute(docs, bench))


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, none).first().contamination.n_hit == 0
    assert decontam.contamination(docs.limit(0), none).count() == 0


def test_against_sql(spark):
    import duckdb

    d, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = {tuple(r) for r in decontam.op3_decontamination(spark, d).collect()}
    assert got == set(con.sql(decontam.SQL).fetchall()) and any(r[-1] for r in got)
