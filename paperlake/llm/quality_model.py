"""Quality classifier: interpolated modified Kneser-Ney character n-grams of trusted text, by language.

Counts come from all trusted texts and stay in tables: n-grams are summed by key, continuation counts, discounts
(Chen and Goodman's three a level) and context totals are aggregations and joins on hash-dealt keys. The model is then
joined to the texts shard by shard: a shard holds what the characters after some set of preceding characters need at
every order, has at most about ``SHARD_ROWS`` rows, and is broadcast alone; each pass adds its share of every
document's log-probability. There are ``HOLD`` models, which share their rows: model m leaves out the trusted
documents of fold m (by a hash of the id). Model 0 decides, so one trusted document in ``HOLD`` is not counted.
Thresholds are cross-fitted: each document has a perplexity by the model without its own fold too, found in the same
pass, and those of all trusted documents calibrate.
A document is kept unless its perplexity exceeds the quantile of calibration documents of its language and length
class; where fewer than ``LEAST`` of them are there, the median of its language times the quantile of the
length class (of all classes, where that has as few) of perplexities divided by their language's median.

Null and empty texts have no perplexity and are not kept; a language (or null) without trusted text is scored by the
model of all trusted text and its quantiles; without any trusted text nothing has a perplexity and all texts are kept.
Rows that repeat an id are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._spark import cut

ORDER = 4
SHARD_ROWS = 1_000_000
QUANTILE = 0.995
HOLD = 5
LEAST = 30
#: Different n-grams that a counting task holds before it hands them on.
HELD_GRAMS = 1_000_000
#: Discounts stay positive, so that no character is impossible.
LEAST_DISCOUNT = 0.1
#: Length classes in characters: short texts vary more.
CLASSES = (150, 500, 2000)
ALL = ""  # the model of all languages
_PAD = "\x02"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(lang: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
    h = lang + np.uint64(len(codes))
    for c in codes:
        h = (h ^ c.astype(np.uint64)) * _BASE
        h ^= h >> np.uint64(29)
    return h


def _lang_code(lang: str) -> np.uint64:
    h = 0xCBF29CE484222325
    for b in lang.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return np.uint64(h & ~0xFF & 0xFFFFFFFFFFFFFFFF)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer((_PAD * (ORDER - 1) + text).encode("utf-32-le"), np.uint32)


def _each(make) -> list[Column]:
    """One column for each of the models; model m leaves out the texts of fold m."""
    return [make(m) for m in range(HOLD)]


def counts(trusted: DataFrame) -> DataFrame:
    """(lang, gram, n0, n1, ...): character n-grams of the highest order in (lang, fold, text) rows, by model, by
    language and for all languages together."""

    def rows(found):
        for (lang, fold), grams in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array([fold] * len(grams), pa.int32()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["lang", "fold", "gram", "n"])

    def run(batches):
        found: dict[tuple[str, int], Counter] = {}
        for batch in batches:
            for lang, fold, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text:
                    padded = _PAD * (ORDER - 1) + text
                    found.setdefault((lang, fold), Counter()).update(map("".join, zip(*(padded[i:] for i in range(ORDER)))))
            if sum(map(len, found.values())) > HELD_GRAMS:
                yield from rows(found)
                found = {}
        yield from rows(found)

    partial = trusted.mapInArrow(run, "lang string, fold int, gram string, n long")
    left_out = _each(lambda m: F.sum(F.when(F.col("fold") != m, F.col("n")).otherwise(F.lit(0))).alias(f"n{m}"))
    own = cut(partial.groupBy("lang", "gram").agg(*left_out))
    together = own.groupBy("gram").agg(*_each(lambda m: F.sum(f"n{m}").alias(f"n{m}")))
    return own.where(F.col("lang") != ALL).unionByName(together.withColumn("lang", F.lit(ALL)))


def model(grams: DataFrame) -> DataFrame:
    """(lang, level, gram, v0, v1, ..., is_gram): by model, the discounted probability of each gram and the back-off
    weight of each context (level - 1 characters); null where a model has none."""
    levels = []
    current = cut(grams)
    for n in range(ORDER, 0, -1):
        levels.append(current.withColumn("level", F.lit(n)))
        if n > 1:  # how many different characters a shorter gram follows
            current = current.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(*_each(lambda m: F.count_if(F.col(f"n{m}") > 0).alias(f"n{m}")))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    every = cut(every.withColumn("context", F.expr("substring(gram, 1, level - 1)")))
    seen = [F.count_if(F.col(f"n{m}") == i).alias(f"t{i}_{m}") for m in range(HOLD) for i in (1, 2, 3, 4)]

    def steps(m):
        t = {i: F.col(f"t{i}_{m}") for i in (1, 2, 3, 4)}
        y = F.when(t[1] > 0, t[1] / (t[1] + 2 * t[2])).otherwise(F.lit(0.5))
        step = lambda i: F.when(t[i] > 0, F.greatest(F.lit(LEAST_DISCOUNT), i - (i + 1) * y * t[i + 1] / t[i])).otherwise(F.lit(0.5))
        return F.array(F.lit(0.0), step(1), step(2), step(3)).alias(f"d{m}")

    d = every.groupBy("lang", "level").agg(*seen).select("lang", "level", *_each(steps))
    cutoff = every.join(F.broadcast(d), ["lang", "level"])  # a row a language and order
    cutoff = cutoff.withColumns({f"c{m}": F.get(f"d{m}", F.least(f"n{m}", F.lit(3)).cast("int")) for m in range(HOLD)})
    sums = [F.sum(f"{x}{m}").alias(f"{y}{m}") for m in range(HOLD) for x, y in (("n", "total"), ("c", "mass"))]
    context = cutoff.groupBy("lang", "level", "context").agg(*sums)
    share = lambda m: F.when(F.col(f"n{m}") > 0, F.greatest(F.lit(0.0), F.col(f"n{m}") - F.col(f"c{m}")) / F.col(f"total{m}")).cast("float").alias(f"v{m}")
    back = lambda m: F.when(F.col(f"total{m}") > 0, F.col(f"mass{m}") / F.col(f"total{m}")).cast("float").alias(f"v{m}")
    shares = cutoff.join(context, ["lang", "level", "context"]).select("lang", "level", "gram", *_each(share), F.lit(True).alias("is_gram"))
    backs = context.select("lang", "level", F.col("context").alias("gram"), *_each(back), F.lit(False).alias("is_gram"))
    return shares.unionByName(backs)


class Shard:
    """Sorted hash arrays of one shard: gram shares and context back-offs of every order, a column for each model.

    ``floor`` has 1 / (characters + 1) of each language and model; 0 where the model lacks the language.
    """

    def __init__(self, rows: pa.Table, floor: dict[str, np.ndarray], members: np.ndarray | None):
        self.floor, self.members = floor, members
        level, is_gram = rows.column("level").to_numpy(), rows.column("is_gram").to_numpy(zero_copy_only=False)
        value = np.stack(_each(lambda m: rows.column(f"v{m}").to_numpy()), axis=1)
        grams = rows.column("gram").to_pylist()
        langs = rows.column("lang").combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
        lang = np.array([_lang_code(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
        self.tables = {}
        for n in range(1, ORDER + 1):
            for kind in (True, False):
                at = np.flatnonzero((level == n) & (is_gram == kind))
                size = n if kind else n - 1
                codes = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), size) if size else np.zeros((len(at), 0), np.uint32)
                h = _hash(lang[at], list(codes.T))
                order = np.argsort(h)
                self.tables[n, kind] = (h[order], np.nan_to_num(value[at][order], nan=0.0 if kind else 1.0))

    def _find(self, n: int, kind: bool, h: np.ndarray) -> np.ndarray:
        keys, values = self.tables[n, kind]
        default = np.float32(0 if kind else 1)
        if not len(keys):
            return np.full((len(h), HOLD), default)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where((keys[at] == h)[:, None], values[at], default)

    def _logs(self, lang: str, codes: np.ndarray) -> np.ndarray:
        key = np.full(codes.shape[1], _lang_code(lang), np.uint64)
        p = np.tile(self.floor[lang], (codes.shape[1], 1))
        for n in range(1, ORDER + 1):
            part = list(codes[ORDER - n :])
            p = self._find(n, True, _hash(key, part)) + self._find(n, False, _hash(key, part[:-1])) * p
        return np.log(p, out=np.zeros_like(p), where=p > 0)  # nothing is found only where a model lacks the language

    def logs(self, lang: str, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities of the last of each row's characters (rows of ORDER), a column a model; 0 where another
        shard has them. A model without the language answers for all languages."""
        has = self.floor.get(lang, np.zeros(HOLD)) > 0
        out = self._logs(lang, codes) if has.any() else np.zeros((codes.shape[1], HOLD))
        if not has.all() and ALL in self.floor:
            out[:, ~has] = self._logs(ALL, codes)[:, ~has]
        if self.members is not None:
            out[~self.members[codes[-2] % len(self.members)]] = 0.0
        return out


def _shards(table: DataFrame, shard_rows: int):
    """Shards of the model, each collected alone: what stands before the predicted character decides the shard.

    Unigrams and the empty context go into every shard (one row a character and language).
    """
    buckets = 4096
    before = F.when(F.col("is_gram"), F.substring("gram", -2, 1)).otherwise(F.substring("gram", -1, 1))
    before = F.when((F.col("level") == 1), F.lit(-1)).otherwise(F.pmod(F.ascii(before), F.lit(buckets)))
    table = cut(table.withColumn("bucket", before.cast("int")))
    size = {r["bucket"]: r["count"] for r in table.groupBy("bucket").count().collect()}  # at most 4097 rows
    unigrams = table.where("bucket = -1 and is_gram").groupBy("lang").agg(*_each(lambda m: F.count(f"v{m}"))).collect()  # a row a language
    floor = {lang: np.array([1.0 / (n + 1) if n else 0.0 for n in found]) for lang, *found in unigrams}
    groups: list[list[int]] = [[]]
    held = 0
    for bucket, n in sorted(size.items()):
        if bucket < 0:
            continue
        if held and held + n > shard_rows:
            groups.append([])
            held = 0
        groups[-1].append(bucket)
        held += n
    for group in groups:
        rows = table.where(F.col("bucket").isin([-1, *group])).drop("bucket").toArrow()
        members = None
        if len(groups) > 1:
            members = np.zeros(buckets, bool)
            members[group] = True
            if group is groups[-1]:  # characters that follow nothing seen are this shard's
                members[[b for b in range(buckets) if b not in size]] = True
        yield Shard(rows, floor, members)


def _add(docs: DataFrame, shard: Shard) -> DataFrame:
    """Adds a shard's log-probabilities to ``logs`` (model 0) and ``own`` (model ``fold``) of the rows."""
    shared = docs.sparkSession.sparkContext.broadcast(shard)

    def run(batches):
        s = shared.value
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            fold = batch.column(3).to_numpy()
            logs, own = (batch.column(i).to_numpy().copy() for i in (4, 5))
            for a in range(0, len(texts), 256):
                for lang in set(langs[a : a + 256]):
                    rows = [i for i in range(a, min(a + 256, len(texts))) if langs[i] == lang and texts[i]]
                    if not rows:
                        continue
                    parts = [_codes(texts[i]) for i in rows]
                    flat = np.concatenate(parts)
                    sizes = np.array([len(p) - ORDER + 1 for p in parts])
                    at = np.arange(sizes.sum()) + np.repeat(np.arange(len(rows)) * (ORDER - 1), sizes)
                    codes = np.stack([flat[at + i] for i in range(ORDER)])
                    h = _hash(np.zeros(len(at), np.uint64), list(codes))
                    _, place, inverse = np.unique(h, return_index=True, return_inverse=True)
                    value = s.logs(lang, codes[:, place])
                    start = np.cumsum(sizes) - sizes
                    logs[rows] += np.add.reduceat(value[inverse, 0], start)
                    own[rows] += np.add.reduceat(value[inverse, np.repeat(fold[rows], sizes)], start)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(logs), pa.array(own)], names=batch.schema.names)

    return docs.mapInArrow(run, "doc_id long, lang string, text string, fold int, logs double, own double")


def _perplexities(rows: DataFrame, grams: DataFrame, shard_rows: int) -> DataFrame:
    """doc_id, lang, fold, n_chars, class and, by model 0 and by the model without the row's own fold, the language
    whose counts answered and the perplexity, of (doc_id, lang, text, fold) rows."""
    scored = rows.withColumns({"logs": F.lit(0.0), "own": F.lit(0.0)}).select("doc_id", "lang", "text", "fold", "logs", "own")
    floor: dict[str, np.ndarray] = {}
    for shard in _shards(model(grams), shard_rows):
        floor = shard.floor
        if floor:
            scored = _add(scored, shard)
    chars = F.coalesce(F.length("text"), F.lit(0))
    size_class = sum(((chars >= c).cast("int") for c in CLASSES), F.lit(0))
    known = [[x for x, f in floor.items() if f[m] > 0] for m in range(HOLD)]
    whose = _each(lambda m: F.when(F.col("lang").isin(known[m]), F.col("lang")).otherwise(F.lit(ALL)))
    mine = F.get(F.array(*whose), "fold")
    some = F.array(*_each(lambda m: F.lit(bool(known[m]))))
    ppl = lambda logs, fold: F.when((chars > 0) & F.get(some, fold), F.exp(-F.col(logs) / chars))
    return cut(
        scored.select(
            "doc_id", "lang", "fold", chars.cast("long").alias("n_chars"), size_class.alias("class"),
            whose[0].alias("model"), ppl("logs", F.lit(0)).alias("perplexity"), mine.alias("own_model"), ppl("own", F.col("fold")).alias("own_perplexity"),
        )
    )


def score(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold and kept of every document.

    ``labels`` (doc_id, quality, toxic) names the trusted ones: quality 1 and not toxic.
    """
    language = F.coalesce(F.col("lang").cast("string"), F.lit(ALL))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language.alias("lang"), "text")
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = trusted.hint("merge")  # ids grow with the corpus: joined by shuffle at every size, never broadcast
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(HOLD)).cast("int")
    base = base.withColumn("fold", F.coalesce(fold, F.lit(0)))
    learned = base.where(F.length("text") > 0).join(trusted, "doc_id", "left_semi")
    scored = _perplexities(base, counts(learned.select("lang", "fold", "text")), shard_rows)
    mine = scored.where("own_perplexity is not null").select("doc_id", F.col("own_model").alias("model"), "class", F.col("own_perplexity").alias("perplexity"))
    mine = cut(mine.join(trusted, "doc_id", "left_semi").drop("doc_id"))
    scored = scored.select("doc_id", "lang", "model", "n_chars", "class", "perplexity")
    quant = lambda x: F.percentile_approx(x, F.lit(quantile), F.lit(10000))
    theirs = mine.where(F.col("model") != ALL)
    own = theirs.groupBy("model", "class").agg(quant("perplexity").alias("threshold"), F.count("*").alias("n")).where(F.col("n") >= LEAST).drop("n")
    middle = theirs.groupBy("model").agg(F.percentile_approx("perplexity", F.lit(0.5), F.lit(10000)).alias("middle"))
    shares = mine.join(F.broadcast(middle), "model", "left").withColumn("share", F.col("perplexity") / F.col("middle"))  # null for all languages
    shape = shares.groupBy("class").agg(quant("share").alias("shape"), F.count("share").alias("n")).where(F.col("n") >= LEAST).drop("n")
    whole = mine.groupBy("class").agg(quant("perplexity").alias("of_class"))
    every = shares.agg(quant("perplexity").alias("of_all"), quant("share").alias("any_shape"))
    # a row a language and length class, a row a language, two a length class, one row
    scored = scored.join(F.broadcast(own), ["model", "class"], "left").join(F.broadcast(middle), "model", "left")
    scored = scored.join(F.broadcast(shape), "class", "left").join(F.broadcast(whole), "class", "left").join(F.broadcast(every), F.lit(True), "left")
    scored = scored.withColumn("threshold", F.coalesce("threshold", F.col("middle") * F.coalesce("shape", "any_shape"), "of_class", "of_all"))
    return scored.select(
        "doc_id", F.nullif("lang", F.lit(ALL)).alias("lang"), "n_chars", "perplexity", "threshold",
        F.when(F.col("n_chars") == 0, False).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("kept"),
    )
