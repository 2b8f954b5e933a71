"""Language ID by interpolated Kneser-Ney character models, one a language, in sorted hash arrays.

A model predicts each character of a word (letters only, lower-cased, between boundaries) from the ``ORDER`` - 1
before it. Words repeat, so a worker scores each different word once and a text by sums over its words. The language
with the lowest cross-entropy per character wins; a prediction whose cross-entropy lies above its language's
calibrated quantile of training texts is flagged as rejected.

Null texts and texts without letters are ``und`` with score 0. Training reads rows with text and language only, at
most about ``PER_LANGUAGE`` documents of each language, chosen by a hash of their id. Without any training rows every
text is ``und``. Rows that repeat an id are judged each; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ORDER = 4
#: Bound on the documents a language is learned from.
PER_LANGUAGE = 1500
#: Training texts' share whose cross-entropy an accepted text may have at most.
ACCEPT = 0.999
CACHE_WORDS = 300_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(codes: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(codes[0]) if codes else 1, len(codes), np.uint64)
    for c in codes:
        h = (h ^ c.astype(np.uint64)) * _BASE
        h ^= h >> np.uint64(29)
    return h


def _grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every predicted character's gram (rows of ``order``), and the word of each.

    A word is led by order - 1 boundaries and ended by one.
    """
    lead = "\n" * (order - 1)
    codes = np.frombuffer((lead + ("\n" + lead).join(words) + "\n").encode("utf-32-le"), np.uint32) if words else np.zeros(0, np.uint32)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(sizes.sum()) + owner * (order - 1) + order - 1
    return np.stack([codes[at - order + 1 + i] for i in range(order)]) if len(at) else np.zeros((order, 0), np.uint32), owner


class Model:
    """Interpolated Kneser-Ney probabilities of characters: sorted hashes of grams and of contexts for each order."""

    def __init__(self, words: dict[str, int], order: int = ORDER):
        names = list(words)
        grams, owner = _grams(names, order)
        weight = np.array([words[w] for w in names], np.int64)[owner]
        self.order = order
        self.tables = []
        unique, inverse = np.unique(grams.T, axis=0, return_inverse=True)
        rows, count = unique.T, np.bincount(inverse.ravel(), weights=weight).astype(np.int64)
        levels = []
        for n in range(order, 0, -1):
            levels.append((rows, count))
            # lower orders count the different characters that a gram follows
            if n > 1:
                shorter, inverse = np.unique(rows[1:].T, axis=0, return_inverse=True)
                rows, count = shorter.T, np.bincount(inverse.ravel())
        for rows, count in reversed(levels):
            n1, n2 = int((count == 1).sum()), int((count == 2).sum())
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context = _hash(list(rows[:-1])) if len(rows) > 1 else np.ones(rows.shape[1], np.uint64)
            keys, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, weights=count)
            kinds = np.bincount(inverse)
            gram = _hash(list(rows))
            order_ = np.argsort(gram)
            share = (np.maximum(count - discount, 0) / total[inverse])[order_].astype(np.float64)
            self.tables.append((gram[order_], share, keys, discount * kinds / total))
        self.floor = 1.0 / (len(levels[-1][1]) + 1)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of the last character of each gram (columns)."""
        p = np.full(grams.shape[1], self.floor)
        for n, (keys, share, contexts, back) in enumerate(self.tables, 1):
            part = list(grams[len(grams) - n :])
            context = _hash(part[:-1]) if n > 1 else np.ones(grams.shape[1], np.uint64)
            p = self._find(keys, share, _hash(part), 0.0) + self._find(contexts, back, context, 1.0) * p
        return np.log(p)


class Scorer:
    """Cross-entropies of texts under the models of all languages, through a bounded cache of words."""

    def __init__(self, models: dict[str, Model], limits: dict[str, float] | None = None):
        self.id = uuid.uuid4().hex
        self.languages = sorted(models)
        self.models = [models[x] for x in self.languages]
        self.limits = limits or {}

    def start(self) -> "Scorer":
        self._number: dict[str, int] = {}
        self._sums = np.zeros((0, len(self.models) + 1))
        return self

    def _learn(self, words: list[str]) -> None:
        grams, owner = _grams(words, self.models[0].order)
        unique, inverse = np.unique(_hash(list(grams)), return_index=True, return_inverse=True)[1:]
        rows = np.zeros((len(words), len(self.models) + 1))
        for i, m in enumerate(self.models):
            rows[:, i] = np.bincount(owner, weights=m.logs(grams[:, unique])[inverse], minlength=len(words))
        letters = np.array([any(map(str.isalpha, w)) for w in words])
        rows[:, -1] = np.where(letters, np.bincount(owner, minlength=len(words)), 0)
        rows[~letters] = 0
        self._number.update(zip(words, range(len(self._sums), len(self._sums) + len(words))))
        self._sums = np.concatenate((self._sums, rows))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character under each model, and the number of characters."""
        split = [_WORD.findall(t.lower()) if t else [] for t in texts]
        if len(self._number) > CACHE_WORDS:
            self.start()
        have = self._number
        new = {w for words in split for w in words if w not in have}
        if new:
            self._learn(sorted(new))
        number = np.fromiter(map(have.__getitem__, chain.from_iterable(split)), np.int64)
        total = np.concatenate((np.zeros((1, len(self.models) + 1)), np.cumsum(self._sums[number], axis=0)))
        edge = np.cumsum([0, *map(len, split)])
        total = total[edge[1:]] - total[edge[:-1]]
        n = np.rint(total[:, -1])
        return -total[:, :-1] / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        if not self.models:
            return [(UNDETERMINED, 0.0, None, False)] * len(texts)
        h, n = self.entropies(texts)
        best = np.argmin(h, axis=1)
        least = h[np.arange(len(h)), best]
        # posterior of the languages, with texts counted as at most 30 characters long to stay below certainty
        score = 1 / np.exp(-(h - least[:, None]) * np.minimum(n, 30)[:, None]).sum(axis=1)
        limit = np.array([self.limits.get(x, np.inf) for x in self.languages])[best]
        return [
            (self.languages[b], s, e, r) if k else (UNDETERMINED, 0.0, None, False)
            for b, s, e, r, k in zip(best.tolist(), score.tolist(), least.tolist(), (least > limit).tolist(), n.tolist())
        ]


_LIVE: dict[str, Scorer] = {}


def _live(scorer: Scorer) -> Scorer:
    """The worker's own copy, whose cache lasts over its tasks."""
    if scorer.id not in _LIVE:
        _LIVE.clear()
        _LIVE[scorer.id] = scorer.start()
    return _LIVE[scorer.id]


def train(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Scorer:
    """A scorer from labelled rows (doc_id, text, lang), each language from about ``per_language`` documents at most."""
    spark = rows.sparkSession
    rows = rows.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    share = {r["lang"]: min(1.0, per_language / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return Scorer({})
    limit = F.create_map(*chain.from_iterable((F.lit(k), F.lit(int(v * 1_000_000))) for k, v in share.items()))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < limit[F.col("lang")])

    def count(batches):
        found: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
        for lang, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words: dict[str, dict[str, int]] = {}
    for r in counted.toLocalIterator():  # bounded by the sample
        words.setdefault(r["lang"], {})[r["word"]] = r["n"]
    scorer = Scorer({lang: Model(w) for lang, w in words.items()})
    shared = spark.sparkContext.broadcast(scorer)

    def calibrate(batches):
        live = _live(shared.value)
        place = {x: i for i, x in enumerate(live.languages)}
        for batch in batches:
            h, n = live.entropies(batch.column(1).to_pylist()) if live.models else (np.zeros((batch.num_rows, 0)), np.zeros(batch.num_rows))
            langs = batch.column(2).to_pylist()
            keep = [i for i, x in enumerate(langs) if n[i] and x in place]
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in keep], pa.string()), pa.array([h[i, place[langs[i]]] for i in keep], pa.float64())], names=["lang", "h"])

    limits = sample.mapInArrow(calibrate, "lang string, h double").groupBy("lang").agg(F.percentile_approx("h", F.lit(ACCEPT), F.lit(10000)).alias("h")).collect()
    return Scorer(scorer.models and dict(zip(scorer.languages, scorer.models)), {r["lang"]: r["h"] for r in limits})


def predict(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        live = _live(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = live.predict(part.column(1).to_pylist())
                types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*found), types))], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"
    )


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document is outside the training fold: crc32 of its id as text, modulo 3, is 1."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(False))
