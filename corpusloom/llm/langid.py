"""Language identification with interpolated Kneser-Ney character models.

Every language has a model of order ``Settings.order`` over the characters of its lower-cased
words, each word padded at both ends. The n-grams of all languages stand in arrays sorted by
hash, one per order, with one column of log-probabilities per language. A text goes to the
language with the lowest cross-entropy per character. Each language's cross-entropies on texts
kept back for calibration give the level beyond which a prediction is marked as rejected.

Models are fitted on a bounded sample: about ``sample_docs`` documents for each language, chosen
by a hash of their id, and half as many for calibration; a language of fewer than ``few`` documents
is learned from all of them and takes the widest level of the others. N-gram counts are made on the
executors, and all n-grams of the sample go into the tables, which the sample bounds.

Cases: a null text or one without a letter gets ``und``, score 0 and is rejected; texts of any
length are read whole; ties go to the language that sorts first; a null lang isn't learned from;
a language of one document is learned from it; with nothing to learn from, every text gets ``und``.
Extra columns stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import bound_batches, free_name, held, materialise

UNKNOWN = "und"
_PAD = 2  # a character that no word holds


@dataclass(frozen=True)
class Settings:
    order: int = 4
    sample_docs: int = 1500
    few: int = 30
    reject_deviations: float = 8.0
    least_deviation: float = 0.05
    cached_words: int = 400_000


@dataclass(frozen=True)
class Model:
    """``grams[o]``: sorted hashes of the (o+1)-grams and log-probabilities (rows, languages);
    ``backoff[o]``: sorted hashes of contexts of length o and the log weights left to shorter
    ones; ``floor``: the log-probability of an unseen character; ``level``: per language mean and
    deviation of the cross-entropy of calibration texts of ``level_chars`` characters."""

    langs: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    backoff: list[tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    level: np.ndarray | None = None
    settings: Settings = Settings()


def _codes(words: list[bytes], order: int, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each with order-1 pads before and one after; where each begins.
    ``length``: their characters. A pad character inside a word becomes a blank."""
    pad = chr(_PAD)
    text = b"\n".join(words).decode("utf-8", "replace").replace(pad, " ")
    text = pad * (order - 1) + text.replace("\n", pad * order) + pad
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), np.append(0, np.cumsum(length + order))


def _gram_hashes(codes: np.ndarray, size: int, last: np.ndarray) -> np.ndarray:
    """Hash of the ``size`` characters that end at each of the places ``last``."""
    h = np.zeros(len(last), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size - 1, -1, -1):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[last - k].astype(np.uint64) + np.uint64(1)
        return h ^ (h >> np.uint64(29)) ^ np.uint64(size)


def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = table[0]
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def word_scores(model: Model, words: list[bytes], length: np.ndarray) -> np.ndarray:
    """Log-probability of each word (with its end) in each language: (words, languages)."""
    n = model.order
    codes, bounds = _codes(words, n, length)
    real = np.ones(len(codes), bool)
    for k in range(n - 1):
        real[bounds[:-1] + k] = False
    at = np.flatnonzero(real)
    total = np.zeros((len(at), len(model.langs)))
    open_ = np.arange(len(at))
    for size in range(n, 0, -1):
        place = at[open_]
        row, hit = _find(model.grams[size - 1], _gram_hashes(codes, size, place))
        total[open_[hit]] += model.grams[size - 1][1][row[hit]]
        open_, place = open_[~hit], place[~hit]
        if size > 1 and len(open_):
            row, known = _find(model.backoff[size - 1], _gram_hashes(codes, size - 1, place - 1))
            total[open_[known]] += model.backoff[size - 1][1][row[known]]
        if not len(open_):
            break
    total[open_] += model.floor
    ends = bounds[1:] - (np.arange(len(words)) + 1) * (n - 1)
    summed = np.vstack([np.zeros((1, len(model.langs))), np.cumsum(total, axis=0)])
    return summed[ends] - summed[np.append(0, ends[:-1])]


class _Scorer:
    """Scores words, remembering those seen before in a bounded sorted array."""

    def __init__(self, model: Model):
        self.model, self.hash, self.row = model, np.zeros(0, np.uint64), np.zeros((0, len(model.langs)), np.float32)

    def rows(self, t: K.Texts, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray) -> np.ndarray:
        at, known = _find((self.hash, self.row), h)
        out = np.zeros((len(h), len(self.model.langs)), np.float32)
        out[known] = self.row[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = t.buf.tobytes()
            for part in range(0, len(new), 16_384):  # bounds the arrays of a call
                at_ = new[part : part + 16_384]
                a, b = starts[at_], ends[at_]
                out[at_] = word_scores(self.model, [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], lead[b] - lead[a])
            if len(self.hash) + len(new) > self.model.settings.cached_words:
                self.hash, self.row = np.zeros(0, np.uint64), np.zeros((0, len(self.model.langs)), np.float32)
            both, rows = np.concatenate([self.hash, h[new]]), np.concatenate([self.row, out[new]])
            order = np.argsort(both, kind="stable")
            self.hash, self.row = both[order], rows[order]
        return out


def cross_entropies(scorer: _Scorer, t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text and language the cross-entropy (nats a character); characters; if it has a letter."""
    starts, ends = t.spans(K.SPACE)
    bounds, owner = t.per_text(starts)
    code, kinds = pd.factorize(t.hashes(starts, ends))
    first = np.full(len(kinds), 0)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    kind_of = t.buf
    lead = np.concatenate([[0], np.cumsum((kind_of & 0xC0) != 0x80)])
    rows = scorer.rows(t, kinds, starts[first], ends[first], lead)
    chars = np.bincount(owner, lead[ends] - lead[starts] + 1, t.n).astype(np.int64)
    sums = np.stack([np.bincount(owner, rows[code, k], t.n) for k in range(rows.shape[1])], 1) if rows.shape[1] else np.zeros((t.n, 0))
    ascii_letter = ((kind_of >= 97) & (kind_of <= 122)) | ((kind_of >= 65) & (kind_of <= 90))
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])
    letters = seen[t.offsets[1:]] > seen[t.offsets[:-1]]
    for i in np.flatnonzero(~letters & (np.diff(t.offsets) > 0)):
        own = t.buf[t.offsets[i] : t.offsets[i + 1]].tobytes()
        letters[i] = any(c.isalpha() for c in own.decode("utf-8", "replace"))
    return -sums / np.maximum(chars, 1)[:, None], chars, letters


class _Shared:
    """A broadcast model and a name for it that survives pickling."""

    def __init__(self, spark, model: Model):
        self.cast, self.id = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def scorer(self) -> _Scorer:
        """The scorer of this process for the model."""
        return held(("language", self.id), lambda: _Scorer(self.cast.value))


_PREDICTION = "struct<lang:string,score:double,cross_entropy:double,chars:bigint,rejected:boolean>"
LEVEL_CHARS = 400.0


def prediction(text: Column, shared: _Shared) -> Column:
    """Language, score, cross-entropy and rejection of each text as one struct column."""

    @F.arrow_udf(_PREDICTION)
    def predict(texts: pa.Array) -> pa.Array:
        scorer = shared.scorer()
        model = scorer.model
        names = np.array([*model.langs, UNKNOWN], object)
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for _, _, t in K.pieces(texts):
            ce, chars, letters = cross_entropies(scorer, t)
            rows = np.arange(t.n)
            if not model.langs:
                for o, v in zip(out, (np.full(t.n, UNKNOWN, object), np.zeros(t.n), np.full(t.n, np.nan), chars, np.ones(t.n, bool)), strict=True):
                    o.append(v)
                continue
            best = ce.argmin(1)
            low = ce[rows, best]
            # a text of few characters says little: evidence counts for at most 60 of them
            score = 1 / np.exp(-(ce - low[:, None]) * np.minimum(chars, 60)[:, None]).sum(1)
            if model.level is None:
                rejected = np.zeros(t.n, bool)
            else:
                mean, dev = model.level[best, 0], model.level[best, 1]
                spread = np.sqrt(np.maximum(1.0, LEVEL_CHARS / np.maximum(chars, 1)))
                rejected = low > mean + model.settings.reject_deviations * dev * spread
            best = np.where(letters, best, len(model.langs))
            for o, v in zip(out, (names[best], np.where(letters, score, 0.0), low, chars, rejected | ~letters), strict=True):
                o.append(v)
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
        arrays = [pa.array(np.concatenate(o) if o else [], k) for o, k in zip(out, kinds, strict=True)]
        return pa.StructArray.from_arrays(arrays, names=["lang", "score", "cross_entropy", "chars", "rejected"])

    return predict(F.lower(text))


def _count_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], int] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for a, b, t in K.pieces(batch.column("text")):
                starts, ends = t.spans(K.SPACE)
                _, owner = t.per_text(starts)
                for lang in set(langs[a:b]):
                    at = np.flatnonzero((langs[a:b] == lang)[owner])
                    code, kinds = pd.factorize(t.hashes(starts[at], ends[at]))
                    first = np.zeros(len(kinds), np.int64)
                    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
                    raw = t.buf.tobytes()
                    words = [raw[starts[i] : ends[i]] for i in at[first].tolist()]
                    codes, bounds = _codes(words, order, np.array([len(w.decode("utf-8", "replace")) for w in words], np.int64))
                    text = codes.astype("<u4").tobytes().decode("utf-32-le", "replace")
                    for n, x, y in zip(np.bincount(code).tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        for i in range(x + order, y + 1):
                            key = (lang, text[i - order : i])
                            total[key] = total.get(key, 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())],
            names=["lang", "gram", "n"],
        )

    return run


def _interpolate(counts: dict[str, int], order: int) -> tuple[list[dict[str, float]], list[dict[str, float]], float]:
    """Interpolated Kneser-Ney of one language from counts of full n-grams: probabilities of the
    n-grams of each size, weights left by each context, and the probability of anything unseen."""
    level: list[dict[str, int]] = [{} for _ in range(order)]
    level[order - 1] = counts
    for size in range(order - 1, 0, -1):  # a shorter n-gram counts the characters seen before it
        own = level[size - 1]
        for g in level[size]:
            own[g[1:]] = own.get(g[1:], 0) + 1
    alphabet = len(level[0]) + 1
    unseen = 1.0 / (alphabet + 1)
    probs: list[dict[str, float]] = [{} for _ in range(order)]
    left: list[dict[str, float]] = [{} for _ in range(order)]
    for size in range(1, order + 1):
        own = level[size - 1]
        ones, twos = sum(1 for c in own.values() if c == 1), sum(1 for c in own.values() if c == 2)
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        total: dict[str, int] = {}
        kinds: dict[str, int] = {}
        for g, c in own.items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
        left[size - 1] = {c: d * kinds[c] / total[c] for c in total}
        lower = probs[size - 2]
        for g, c in own.items():
            ctx = g[:-1]
            below = lower[g[1:]] if size > 1 else unseen
            probs[size - 1][g] = (c - d) / total[ctx] + left[size - 1][ctx] * below
    return probs, left, left[0].get("", 1.0) * unseen


def build_model(counts: dict[str, dict[str, int]], settings: Settings) -> Model:
    """Tables of all languages from their n-gram counts. An n-gram known to any language gets its
    interpolated log-probability in every language, so one look-up serves them all."""
    langs, n = sorted(counts), settings.order
    parts = [_interpolate(counts[la], n) for la in langs]
    grams, backoff = [], []
    floor = np.log(np.array([p[2] for p in parts]) if parts else np.zeros(0))

    def prob(k: int, g: str) -> float:
        probs, left, low = parts[k]
        weight = 1.0
        while g:
            if g in probs[len(g) - 1]:
                return weight * probs[len(g) - 1][g]
            weight *= left[len(g) - 1].get(g[:-1], 1.0)
            g = g[1:]
        return weight * low / left[0].get("", 1.0) if left[0].get("", 1.0) else low

    def table(keys: list[str], size: int, value) -> tuple[np.ndarray, np.ndarray]:
        if not keys:
            return np.zeros(0, np.uint64), np.zeros((0, len(langs)))
        codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32)
        h = _gram_hashes(codes, size, np.arange(size - 1, len(codes), size))
        v = np.log(np.array([[value(k, g) for k in range(len(langs))] for g in keys]))
        order = np.argsort(h)
        return h[order], v[order]

    for size in range(1, n + 1):
        keys = sorted(set().union(*[p[0][size - 1] for p in parts])) if parts else []
        grams.append(table(keys, size, prob))
        contexts = sorted(set().union(*[p[1][size - 1] for p in parts])) if parts and size > 1 else []
        backoff.append(table(contexts, size - 1, lambda k, c, s=size: parts[k][1][s - 1].get(c, 1.0)) if size > 1 else (np.zeros(0, np.uint64), np.zeros((0, len(langs)))))
    return Model(langs, n, grams, backoff, floor, None, settings)


def learn(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from the rows of ``docs`` (doc_id, text, lang) that it is given."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    per_lang = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per_lang:
        return build_model({}, settings)
    # a share of each language's rows by a hash of the id: about sample_docs to learn, half to calibrate
    draw = (F.xxhash64(F.col("doc_id").cast("string"), F.lit("draw")).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)).alias("draw")
    learned = {la: 1.0 if n < settings.few else min(settings.sample_docs / n, 0.67) for la, n in per_lang.items()}
    share = F.create_map(*[x for la, part in learned.items() for x in (F.lit(la), F.lit(part))])
    rows = rows.select("lang", F.lower("text").alias("text"), draw, share[F.col("lang")].alias("share"))
    sample = materialise(rows.where("draw < 1.5 * share"))
    counted = sample.where("draw < share").select("lang", "text").mapInArrow(_count_grams(settings.order), "lang string, gram string, n long")
    counts: dict[str, dict[str, int]] = {}
    for r in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r.lang, {})[r.gram] = r.n
    model = build_model(counts, settings)
    if not model.langs:
        return model
    # written before it is filtered: else each use of the prediction takes a Python worker of its own
    checked = materialise(sample.where("draw >= share").select("lang", prediction(F.col("text"), _Shared(spark, model)).alias("p")))
    checked = checked.where("p.lang = lang and p.chars >= 100")
    weight = F.sqrt(F.least(F.lit(1.0), F.col("p.chars") / LEVEL_CHARS))
    found = {r.lang: r for r in checked.groupBy("lang").agg(F.avg("p.cross_entropy").alias("m"), F.stddev_pop(F.col("p.cross_entropy") * weight).alias("d")).collect()}
    widest = [max((r.m for r in found.values()), default=3.0), max([settings.least_deviation, *(r.d for r in found.values())])]
    level = np.array([[found[la].m, max(found[la].d, settings.least_deviation)] if la in found else widest for la in model.langs])
    return Model(model.langs, model.order, model.grams, model.backoff, model.floor, level, settings)


def identify(docs: DataFrame, learn_from: DataFrame, settings: Settings = Settings(), model: Model | None = None) -> DataFrame:
    """``docs`` with one more struct column, ``free_name(docs, "language")``: with an underscore behind it
    where ``docs`` has such a column."""
    bound_batches(docs.sparkSession)
    model = model or learn(learn_from, settings)
    return docs.withColumn(free_name(docs, "language"), prediction(F.col("text"), _Shared(docs.sparkSession, model)))
