"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm.common import small_batches, stored

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
ORDERS = (1, 2, 3)
#: Words whose scores a Python worker remembers; beyond that it forgets all and starts anew.
CACHED_WORDS = 200_000
#: Longer words, as text without spaces gives, are scored but not remembered.
LONGEST_CACHED = 40
RESULT = "lang_pred string, score double, ambiguous boolean"


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def grams_of(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in ORDERS for i in range(n == 1, len(padded) - n + 1 - (n == 1))]


def code_matrix(languages: int) -> np.ndarray:
    """Codewords of +1 and -1, one row per language.

    Up to seven languages get the exhaustive code: every way to part them in two. More get random dense
    words of ten bits per doubling, the draw of 50 whose nearest two words are farthest apart.
    """
    if languages < 2:
        return np.zeros((languages, 0))
    if languages <= 7:
        sides = [[1 if l == 0 or (s >> (l - 1)) & 1 else -1 for l in range(languages)] for s in range(2 ** (languages - 1) - 1)]
        return np.array(sides, dtype=np.float64).reshape(-1, languages).T
    rng = np.random.default_rng(0)
    bits = 10 * int(np.ceil(np.log2(languages)))
    best, far = None, -1.0
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(languages, bits))
        code[0] = np.where(np.abs(code.sum(axis=0)) == languages, -code[0], code[0])
        apart = (bits - code @ code.T) / 2 + np.eye(languages) * bits
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Model:
    """Languages, their codewords, each bit's n-gram weights, and per bit the scale of its margins and its loss weight."""

    languages: list[str]
    code: np.ndarray
    rows: dict[str, int]
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray
    gap: float = 0.05
    _cache: dict[str, int] = field(default_factory=dict, repr=False)
    _scores: np.ndarray | None = field(default=None, repr=False)

    def _word_scores(self, words: list[str]) -> np.ndarray:
        """Summed weights and n-gram count of each word."""
        found = [[r for g in grams_of(w) if (r := self.rows.get(g)) is not None] for w in words]
        out = np.zeros((len(words), self.weights.shape[1] + 1))
        out[:, -1] = [len(r) for r in found]
        flat = np.fromiter((r for rows in found for r in rows), dtype=np.int64)
        ends = np.cumsum(out[:, -1].astype(np.int64))
        some = np.nonzero(out[:, -1])[0]
        if len(some):
            starts = (ends - out[:, -1].astype(np.int64))[some]
            out[some, :-1] = np.add.reduceat(self.weights[flat], starts, axis=0)
        return out

    def margins(self, text: str) -> np.ndarray | None:
        """Mean weight of the text's n-grams for each bit; None where it has no known n-gram."""
        words = words_of(text)
        total = np.zeros(self.weights.shape[1] + 1)
        long = [w for w in words if len(w) > LONGEST_CACHED]
        for w in long:
            total += self._word_scores([w])[0]
        if long:
            words = [w for w in words if len(w) <= LONGEST_CACHED]
        for at in range(0, len(words), CACHED_WORDS // 2):
            part = words[at : at + CACHED_WORDS // 2]
            new = list(set(part).difference(self._cache))
            if self._scores is None or len(self._cache) + len(new) > CACHED_WORDS:
                self._cache, new = {}, list(set(part))
                self._scores = np.zeros((CACHED_WORDS, self.weights.shape[1] + 1))
            if new:
                first = len(self._cache)
                self._scores[first : first + len(new)] = self._word_scores(new)
                self._cache.update(zip(new, range(first, first + len(new)), strict=True))
            total += self._scores[np.fromiter(map(self._cache.__getitem__, part), np.int64, len(part))].sum(axis=0)
        return total[:-1] / total[-1] if total[-1] else None

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """The language whose codeword has the least weighted logistic loss, its share, and whether another is as near."""
        losses = np.logaddexp(0.0, -self.code * (margins / self.scale)) @ self.trust
        order = np.argsort(losses, kind="stable")
        share = np.exp(losses[order[0]] - losses)
        near = len(order) > 1 and losses[order[1]] - losses[order[0]] < self.gap * self.trust.sum()
        return self.languages[order[0]], float(1 / share.sum()), bool(near)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not words_of(text):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margins = self.margins(text)
        return self.decode(np.zeros(len(self.scale)) if margins is None else margins)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
    for lang, words in counts.items():
        grams: Counter = Counter()
        for word, n in words.items():
            for gram in grams_of(word):
                grams[gram] += n
        columns = [pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


def _drawn(labelled: DataFrame, per_language: int, max_languages: int) -> tuple[list[str], DataFrame]:
    """The languages, and about ``per_language`` different texts of each, drawn by a hash of the text."""
    rows = labelled.select("lang", "text").where("lang is not null and text is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts"))
    sizes = {r["lang"]: r["texts"] for r in found.orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not sizes:
        return [], rows
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / max(n, 1)))]), F.col("lang"))
    drawn = rows.where(F.pmod(F.xxhash64("text", F.lit("draw")), F.lit(1 << 20)) / float(1 << 20) < rate)
    return sorted(sizes), drawn.dropDuplicates(["lang", "text"])


def fit(labelled: DataFrame, per_language: int = 1500, max_grams: int = 1 << 15, gap: float = 0.05, max_languages: int = 512) -> Model:
    """Fit on ``labelled(text, lang)``.

    The classifier sees a bounded sample: texts are drawn by a hash, each once however many copies it has,
    so that about ``per_language`` different texts of each language come in (all, where there are fewer). Of
    the labels the ``max_languages`` most frequent are learned, so a dirty column stays within bounds. The
    model keeps the ``max_grams`` most frequent n-grams. Each bit is a naive Bayes classifier: its n-gram weights
    are log ratios between the languages on its two sides, each language counting alike. A bit's margins are
    scaled by a third of their mean size, and its loss weight is half the log odds of its accuracy on the
    sample, both added up in Spark. Null texts or languages are left out; without any labelled row every
    text is ``und``.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    languages, drawn = _drawn(labelled, per_language, max_languages)
    if len(languages) < 2:
        return Model(languages, code_matrix(len(languages)), {}, np.zeros((0, 0)), np.ones(0), np.ones(0), gap)
    sample = stored(drawn, "language-sample")
    counts = sample.mapInArrow(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.groupBy("gram").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "gram").limit(max_grams)
    kept = counts.join(F.broadcast(top), "gram").select("gram", "lang", "n").toPandas()
    grams = sorted(kept["gram"].unique())
    place = {g: i for i, g in enumerate(grams)}
    at = {l: i for i, l in enumerate(languages)}
    table = np.full((len(grams), len(languages)), 0.5)
    table[kept["gram"].map(place).to_numpy(dtype=int), kept["lang"].map(at).to_numpy(dtype=int)] += kept["n"].to_numpy(dtype=float)
    table /= table.sum(axis=0)
    code = code_matrix(len(languages))
    ones = (code > 0).astype(float)
    weights = np.log(table @ ones / ones.sum(axis=0)) - np.log(table @ (1 - ones) / (1 - ones).sum(axis=0))
    model = Model(languages, code, place, weights, np.ones(code.shape[1]), np.ones(code.shape[1]), gap)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, size, right = shared.value, 0, np.zeros(code.shape[1]), np.zeros(code.shape[1], np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                margins = own.margins(text)
                if margins is not None:
                    n, size, right = n + 1, size + np.abs(margins), right + (margins * code[at[lang]] > 0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([size.tolist()]), pa.array([right.tolist()])], ["n", "size", "right"])

    sums = sample.mapInArrow(measure, "n long, size array<double>, right array<long>").collect()
    seen = sum(r["n"] for r in sums)
    if seen:
        model.scale = np.maximum(sum(np.array(r["size"]) for r in sums) / seen / 3, 1e-6)
        right = (sum(np.array(r["right"]) for r in sums) + 1) / (seen + 2)
        model.trust = np.clip(0.5 * np.log(right / (1 - right)), 0.05, None)
    model._cache, model._scores = {}, None
    return model


def language(text: Column, model: Model) -> Column:
    """A struct ``(lang_pred, score, ambiguous)`` for each whole text.

    ``und`` with score 0 and the ambiguity flag for a null text or one without letters. Only the text
    enters a prediction.
    """
    spark = SparkSession.active()
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    return predict(text)
