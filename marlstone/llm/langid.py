"""Language identification in two steps: the family, then the language within it.

Each step is a set of one-versus-one linear support vector machines over hashed
byte n-grams. They are fitted on a bounded sample of labelled rows, alike for each
language, and applied to every whole text.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import crc_mod, table, text_view, tidy, tune
from .features import bounded_sample, by_steps, ngram_counts, unit_rows

WIDTH = 4096
#: Expected rows that a language gives to the fit, and that all give together: the bound of what the driver gathers.
PER_LANGUAGE, ALL_LANGUAGES = 600, 4000
#: Languages that are told apart, the most frequent ones.
MOST_LANGUAGES = 500
#: Names that one set of pairwise machines holds; more are told apart group by group, ``GROUPS`` (a power of 2) at a time.
MOST_NAMES, GROUPS = 24, 8
UNKNOWN = "und"
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
}


def features(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return unit_rows(np.log1p(ngram_counts(data, docs, WIDTH, fold=True).astype(np.float32)))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, classes weighed alike. y: 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y = y.astype(np.float32)
    step = np.float32(1.0 / (1.0 / cost + 2.0 * (x * x).sum(axis=1).max()))
    w, v = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v / np.float32(cost) - 2 * (x.T @ (each * y * slack)))
        w, v = new, new + np.float32(k / (k + 3)) * (new - w)
    return w


@dataclass
class Machines:
    """One-versus-one machines of some names."""

    names: list[str]
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray) -> Machines:
        names = sorted(set(labels.tolist()))
        out = []
        for a, b in itertools.combinations(names, 2):
            own = (labels == a) | (labels == b)
            out.append(fit_svm(x[own], np.where(labels[own] == a, 1.0, -1.0)))
        return Machines(names, np.array(out).reshape(len(out), x.shape[1] + 1))

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the winner among names, by votes and then margins, and how sure it is."""
        n = len(self.names)
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1] if n > 1 else np.zeros((len(x), 0))
        votes, sums, least = np.zeros((len(x), n)), np.zeros((len(x), n)), np.ones((len(x), n))
        for k, (a, b) in enumerate(itertools.combinations(range(n), 2)):
            m = margin[:, k]
            p = 1 / (1 + np.exp(-4 * m))
            for i, won, q, s in ((a, m > 0, p, m), (b, m <= 0, 1 - p, -m)):
                votes[:, i] += won
                sums[:, i] += s
                least[:, i] = np.minimum(least[:, i], q)
        best = (votes + 1e-6 * np.tanh(sums)).argmax(axis=1)
        return best, least[np.arange(len(x)), best]


def _halves(places: np.ndarray, centres: np.ndarray, parts: int) -> list[np.ndarray]:
    """Names in groups of about equal size: halved again and again along the main direction of their means."""
    if parts == 1 or len(places) == 1:
        return [places]
    own = centres[places] - centres[places].mean(axis=0)
    main = np.linalg.svd(own, full_matrices=False)[2][0]
    main = main if main[np.abs(main).argmax()] > 0 else -main
    order = places[np.argsort(own @ main, kind="stable")]
    half = (len(order) + 1) // 2
    return [*_halves(order[:half], centres, parts // 2), *_halves(order[half:], centres, parts // 2)]


@dataclass
class Tree:
    """Names in groups of alike ones: machines choose a group first, then inside it. Machines grow with the names, not their pairs."""

    names: list[str]
    top: Machines
    groups: list[np.ndarray]
    below: list

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, sure = self.top.choose(x)
        best = np.zeros(len(x), np.int64)
        for g, names in enumerate(self.groups):
            rows = np.flatnonzero(at == g)
            if len(rows):
                inside, p = self.below[g].choose(x[rows])
                best[rows] = np.sort(names)[inside]
                sure[rows] *= p
        return best, sure


def _fit_in_span(x: np.ndarray, labels: np.ndarray) -> Machines:
    """Machines fitted on the rows' coordinates in the space that they span, which is where their weights lie."""
    if len(x) >= x.shape[1]:
        return Machines.fit(x, labels)
    axes, r = np.linalg.qr(x.T)
    made = Machines.fit(np.ascontiguousarray(r.T), labels)
    return Machines(made.names, np.column_stack([made.weights[:, :-1] @ axes.T, made.weights[:, -1]]).astype(made.weights.dtype).reshape(len(made.weights), x.shape[1] + 1))


def fit_names(x: np.ndarray, labels: np.ndarray, inner: bool = False) -> Machines | Tree:
    """Machines between all pairs of ``MOST_NAMES`` names at most, else a tree of such. ``inner``: of a tree's nodes, which have few rows."""
    names = sorted(set(labels.tolist()))
    if len(names) <= MOST_NAMES:
        return _fit_in_span(x, labels) if inner else Machines.fit(x, labels)
    at = np.searchsorted(names, labels)
    centres = np.stack([x[at == k].mean(axis=0) for k in range(len(names))])
    groups = _halves(np.arange(len(names)), centres, GROUPS)
    of = np.zeros(len(names), np.int64)
    for g, places in enumerate(groups):
        of[places] = g
    top = _fit_in_span(x, np.array([f"{g:02d}" for g in range(len(groups))])[of[at]])
    return Tree(names, top, groups, [fit_names(x[of[at] == g], labels[of[at] == g], True) for g in range(len(groups))])


@dataclass
class Model:
    families: Machines | Tree
    within: dict[str, Machines | Tree]

    @staticmethod
    def fit(x: np.ndarray, langs: np.ndarray, families: dict[str, str]) -> Model:
        of = np.array([families.get(v, v) for v in langs.tolist()])
        return Model(fit_names(x, of), {f: fit_names(x[of == f], langs[of == f]) for f in sorted(set(of.tolist()))})

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The family first, then a language of that family."""
        at, sure = self.families.choose(x)
        names, score = [""] * len(x), sure.copy()
        for k, f in enumerate(self.families.names):
            rows = np.flatnonzero(at == k)
            if len(rows):
                best, p = self.within[f].choose(x[rows])
                score[rows] *= p
                for r, b in zip(rows.tolist(), best.tolist(), strict=True):
                    names[r] = self.within[f].names[b]
        return names, score


def fit_model(rows: DataFrame, families: dict[str, str] = FAMILIES, per_language: int = PER_LANGUAGE, all_languages: int = ALL_LANGUAGES, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """Fit on ``text, lang`` rows (and ``doc_id``, if there); rows without either don't count. None if there are none.

    The driver gathers ``all_languages`` rows at most, as expected, of the ``most_languages``
    most frequent languages; the others, and those that give no row, are never predicted.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    there = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not there:
        return None
    share = min(per_language, all_languages / len(there))
    # the id keeps a large group of copies from being chosen as one
    by = [c for c in ("doc_id", "text") if c in rows.columns]
    some = bounded_sample(rows.select("lang", *by), {k: (n, share) for k, n in there.items()}, "lang", 2, by).select("lang", "text")

    def run(batches):
        for b in batches:
            for at, x in zip(range(0, b.num_rows, 64), (features(*text_view(b.column("text").slice(a, 64))) for a in range(0, b.num_rows, 64)), strict=True):
                yield pa.RecordBatch.from_arrays([b.column("lang").slice(at, 64), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = some.mapInArrow(tidy(run), "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return Model.fit(x, np.array(got.column("lang").to_pylist()), families)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` and a struct ``out``: lang_pred and score.

    Null texts, texts without a letter, and all texts where nothing could be
    learned are ``und`` with score 0. Rows are judged one by one.
    """
    tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    @tidy
    def run(texts: pa.Array) -> pa.Array:
        def step(data, off, part):
            letters = np.array([t is not None and any(map(str.isalpha, t)) for t in part.to_pylist()], bool)
            if held.value is None:
                return [UNKNOWN] * len(part), np.zeros(len(part))
            names, score = held.value.predict(features(data, off))
            return [n if k else UNKNOWN for n, k in zip(names, letters, strict=True)], np.where(letters, score, 0.0)

        made = list(by_steps(texts, step))
        return pa.StructArray.from_arrays([pa.array([n for m in made for n in m[0]], pa.string()), pa.array(np.concatenate([m[1] for m in made]) if made else [], pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(out, run(F.col(text_col).cast("string")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document.

    Null texts and those without a letter are ``und`` with score 0; very long ones are read
    whole. Rows are judged one by one, so repeated rows and ids get equal results; without
    labelled rows all are ``und``, and an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = crc_mod("doc_id", 3) == 1
    got = identify(docs.select("doc_id", "text"), fit_model(docs.where(~out)))
    return got.select("doc_id", out.alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))


QUERIES = {"op2_language_id": op2_language_id}
