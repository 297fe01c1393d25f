"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are each compared
with references of every language by Jensen-Shannon distance (base 2, so between 0 and 1); the
nearest language counts. References come from all documents: the common words of a language are
its most frequent words among those that make up at least ``min_share`` of its words. They are
found exactly in two passes: a Misra-Gries summary in every task (a word of that share survives in
at least the total), then exact counts of the survivors.

Cases: null or empty text has no words, so it fails the base rule; null lang takes no part in the
references but is judged; documents shorter than ``min_words`` are left to the base rule; ties
among common words go by the word itself; with no reference at all (empty table) only the base
rule holds. Extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import bound_batches, forget, free_name, materialise, small


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. The class distance may be ``class_slack / sqrt(words)`` larger, as a
    short text strays further by chance."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_class_distance: float = 0.175
    class_slack: float = 0.6
    max_word_distance: float = 0.38
    common_words: int = 40
    min_share: float = 0.002
    min_reference_words: int = 1000


@dataclass(frozen=True)
class References:
    """Per language: shares of the character classes, and of the common words and the rest."""

    langs: list[str]
    classes: np.ndarray
    words: list[list[str]]
    shares: list[np.ndarray]


def _misra_gries(words: dict[bytes, int], keep: int) -> dict[bytes, int]:
    if len(words) <= keep:
        return words
    cut = sorted(words.values(), reverse=True)[keep]
    return {w: c - cut for w, c in words.items() if c > cut}


def _heavy_words(t: K.Texts, starts: np.ndarray, ends: np.ndarray, most: int) -> tuple[list[bytes], np.ndarray]:
    """The ``most`` most frequent words of the given spans and their counts less the next one's."""
    code, _ = pd.factorize(t.hashes(starts, ends))
    count = np.bincount(code)
    cut = int(np.partition(count, -most - 1)[-most - 1]) if len(count) > most else 0
    heavy = np.flatnonzero(count > cut)
    first = np.full(len(count), -1)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return [t.buf[starts[i] : ends[i]].tobytes() for i in first[heavy]], count[heavy] - cut


def _summaries(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, dict[bytes, int]] = {}
        total: dict[str, int] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for a, b, t in K.pieces(batch.column("text")):
                starts, ends = t.spans(K.SPACE)
                _, owner = t.per_text(starts)
                for lang in set(langs[a:b]) - {None}:
                    at = np.flatnonzero((langs[a:b] == lang)[owner])
                    own = words.setdefault(lang, {})
                    found, count = _heavy_words(t, starts[at], ends[at], keep)
                    for w, c in zip(found, count.tolist(), strict=True):
                        own[w] = own.get(w, 0) + c
                    words[lang] = _misra_gries(own, keep)
                    total[lang] = total.get(lang, 0) + len(at)
        rows = [(la, w.decode("utf-8", "replace"), c, 0) for la, d in words.items() for w, c in d.items()]
        rows += [(la, None, 0, n) for la, n in total.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
            names=["lang", "word", "seen", "total"],
        )

    return run


class _Lookup:
    """Positions of words in a list, by hash."""

    def __init__(self, words: list[str]):
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
        starts = np.append(0, ends[:-1]).astype(np.int64) if raw else ends
        h = K.Texts(np.frombuffer(b"".join(raw), np.uint8), np.append(0, ends)).hashes(starts, ends)
        self.order = np.argsort(h)
        self.sorted = h[self.order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The position of each hash, or -1."""
        if not len(self.sorted):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)


def _exact_counts(candidates: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, width = _Lookup(candidates), len(candidates)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for a, b, t in K.pieces(batch.column("text")):
                starts, ends = t.spans(K.SPACE)
                _, owner = t.per_text(starts)
                at = look.find(t.hashes(starts, ends))
                names, code = np.unique(langs[a:b].astype(str), return_inverse=True)
                chars = K.class_counts(t)
                for k, lang in enumerate(names):
                    mine = (code == k) & np.array([x is not None for x in langs[a:b]])
                    if mine.any():
                        own = total.setdefault(str(lang), np.zeros(width + 1 + len(K.CLASSES), np.int64))
                        own[: width + 1] += np.bincount(at[mine[owner]] + 1, minlength=width + 1)
                        own[width + 1 :] += chars[mine].sum(0)
        # slot -1 holds the words that are no candidate, slots from `width` on the classes
        langs_out, slots, counts = [], [], []
        for lang, own in total.items():
            keep = np.flatnonzero(own)
            langs_out += [lang] * len(keep)
            slots += (keep - 1).tolist()
            counts += own[keep].tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs_out, pa.string()), pa.array(slots, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "slot", "n"]
        )

    return run


def learn_references(docs: DataFrame, rules: Rules) -> References:
    """References from all rows of ``docs`` (text, lang). What reaches the driver is bounded by
    the languages times about ``2 / min_share`` words."""
    rows = docs.select("lang", "text").where("lang is not null and text is not null")
    keep = int(np.ceil(2 / rules.min_share))
    found = rows.mapInArrow(_summaries(keep), "lang string, word string, seen long, total long")
    found = materialise(found.groupBy("lang", "word").agg(F.sum("seen").alias("seen"), F.sum("total").alias("total")))
    # only languages with enough words get a reference
    totals = found.where("word is null").select("lang", F.col("total").alias("words")).where(F.col("words") >= rules.min_reference_words)
    n_langs = totals.count()
    # a survivor's count is short by at most words / keep, half of the share asked for
    likely = found.where("word is not null").join(small(totals, n_langs), "lang").where(F.col("seen") >= F.col("words") * (rules.min_share - 1 / keep))
    candidates = sorted({r.word for r in likely.select("word").distinct().collect()})
    exact = rows.mapInArrow(_exact_counts(candidates), "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    exact = exact.join(small(totals.select("lang"), n_langs), "lang", "left_semi")
    by_lang: dict[str, np.ndarray] = {}
    for r in exact.collect():
        by_lang.setdefault(r.lang, np.zeros(len(candidates) + 1 + len(K.CLASSES)))[r.slot + 1] = r.n
    langs, classes, words, shares = [], [], [], []
    for lang in sorted(by_lang):
        own = by_lang[lang]
        n = own[: len(candidates) + 1].sum()
        if n < rules.min_reference_words:
            continue
        counts = own[1 : len(candidates) + 1]
        common = [i for i in np.argsort(-counts, kind="stable") if counts[i] >= rules.min_share * n][: rules.common_words]
        langs.append(lang)
        classes.append(own[len(candidates) + 1 :] / own[len(candidates) + 1 :].sum())
        words.append([candidates[i] for i in common])
        shares.append(np.append(counts[common], n - counts[common].sum()) / n)
    return References(langs, np.array(classes).reshape(len(langs), len(K.CLASSES)), words, shares)


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to the reference; 0 for a row of zeros."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0.0)


_VERDICT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "class_distance:double,word_distance:double,base_failed:boolean,kept:boolean>"
)


def verdict(text: Column, refs: References, rules: Rules) -> Column:
    """The counts, distances and verdict of each text, as one struct column."""

    @F.arrow_udf(_VERDICT)
    def judge(texts: pa.Array) -> pa.Array:
        forget()
        union = sorted({w for ws in refs.words for w in ws})
        look = _Lookup(union)
        slots = [np.array([union.index(w) for w in ws], np.int64) for ws in refs.words]
        parts: dict[str, list[np.ndarray]] = {}
        for _, _, t in K.pieces(texts):
            base, chars, h, bounds = K.basic_counts(t)
            n = base["n_words"]
            if refs.langs:
                owner = np.repeat(np.arange(t.n), n)
                at = look.find(h)
                hit = at >= 0
                common = np.bincount(owner[hit] * max(len(union), 1) + at[hit], minlength=t.n * max(len(union), 1)).reshape(t.n, -1)
                dc = np.stack([js_distance(chars, r) for r in refs.classes])
                dw = np.stack([js_distance(np.column_stack([own := common[:, s], n - own.sum(1)]), r) for s, r in zip(slots, refs.shares, strict=True)])
                near = (dc + dw).argmin(0)
                dc, dw = dc[near, np.arange(t.n)], dw[near, np.arange(t.n)]
            else:
                dc = dw = np.zeros(t.n)
            failed = (n < rules.min_words) | (100 * base["n_repeat_words"] > rules.max_repeat_percent * n)
            kept = ~failed & (dc <= rules.max_class_distance + rules.class_slack / np.sqrt(np.maximum(n, 1))) & (dw <= rules.max_word_distance)
            for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
                parts.setdefault(k, []).append(base[k].astype(np.int64))
            for k, v in (("class_distance", dc), ("word_distance", dw), ("base_failed", failed), ("kept", kept)):
                parts.setdefault(k, []).append(v)
        names = [f.split(":")[0] for f in _VERDICT[7:-1].split(",")]
        kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
        return pa.StructArray.from_arrays([pa.array(np.concatenate(parts[k]) if k in parts else [], kind) for k, kind in zip(names, kinds, strict=True)], names=names)

    return judge(text)


def judge_documents(docs: DataFrame, rules: Rules = Rules(), refs: References | None = None) -> DataFrame:
    """``docs`` with one more column, ``free_name(docs, "quality_verdict")``; references are learned where
    not given."""
    bound_batches(docs.sparkSession)
    refs = refs or learn_references(docs, rules)
    return docs.withColumn(free_name(docs, "quality_verdict"), verdict(F.col("text"), refs, rules))
