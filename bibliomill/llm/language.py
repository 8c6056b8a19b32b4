"""Language identification with averaged subword embeddings.

A text is the average of the embeddings of its hashed character n-grams, and a linear softmax
over that average names the language.  Embeddings and softmax are trained by stochastic
gradient descent in numpy on word windows of a bounded sample of labelled texts
(``PER_LANGUAGE`` texts each, ``SAMPLE_CHARS`` characters of each from a place fixed by its
hash).  The model being linear after the average, a trained model is one row of logits per
hash bucket, and a word's logits are summed once.

Scores are calibrated on texts of the sample that training did not see: the logits are
scaled by a power of the number of n-grams, so short texts are less sure than long ones.  A
prediction is accepted where the score reaches the smallest threshold at which accepted
validation windows are right to ``PRECISION``; below it the operator rejects.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; if nothing
can be learned (no labelled row, an empty table) every text is ``und``; a text whose letters
were never seen gets the likeliest language with a low score; repeated rows get equal
answers; other columns play no part.  Texts of any length are read as a whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliomill.llm.common import worker_state

PER_LANGUAGE = 500
SAMPLE_CHARS = 4000
BUCKETS = 1 << 16
DIMENSIONS = 16
GRAMS = (1, 2, 3, 4)
STEPS = 1500
RATE = 0.3
BATCH = 32
PRECISION = 0.97
UNKNOWN = "und"
CACHE_WORDS = 400_000
WORDS = re.compile(r"[^\W\d_]+")


def has_letter(words) -> bool:
    return any(w.isalpha() or any(map(str.isalpha, w)) for w in words)


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and the number of the word each belongs to."""
    codes = np.frombuffer("\n".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    broken = codes == 10
    word = np.cumsum(broken)
    out, owner = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(codes) < n:
                continue
            value = np.full(len(codes) - n + 1, n, np.uint64)
            for i in range(n):
                value = value * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - n + 1 + i] + np.uint64(1)
            inside = (word[: len(word) - n + 1] == word[n - 1 :]) & ~broken[: len(word) - n + 1] & ~broken[n - 1 :]
            out.append(((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(BUCKETS))
            out[-1] = out[-1][inside].astype(np.int64)
            owner.append(word[: len(word) - n + 1][inside])
    return np.concatenate(out), np.concatenate(owner)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # one row per bucket
    bias: np.ndarray
    scale: float  # calibration: logits times exp(scale) * n ** power
    power: float
    threshold: float

    def probabilities(self, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) * (np.exp(self.scale) * np.maximum(n, 1.0) ** self.power)[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _windows(text: str, rng: np.random.Generator) -> list[list[str]]:
    words = WORDS.findall(text.lower())
    out = []
    for size in (2 ** rng.uniform(0, 3), 2 ** rng.uniform(2, 5), 2 ** rng.uniform(4, 7)):
        size = int(size)
        at = int(rng.integers(0, max(1, len(words) - size + 1)))
        out.append(words[at : at + size])
    return [w for w in out if has_letter(w)]


def train(texts: list[str], labels: list[str], seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    number = {g: i for i, g in enumerate(languages)}
    examples, gold, held = [], [], []
    for i, (text, label) in enumerate(zip(texts, labels)):
        for window in _windows(text, rng):
            examples.append(buckets_of(window)[0])
            gold.append(number[label])
            held.append(zlib.crc32(text.encode("utf-8", "replace")) % 5 == 0)
    gold, held = np.array(gold, np.int64), np.array(held, bool)
    classes = len(languages)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight = np.zeros((DIMENSIONS, classes), np.float32)
    bias = np.zeros(classes, np.float32)
    learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(gold))
    step = 0
    weight += rng.normal(0, 0.1, weight.shape).astype(np.float32)
    while step < STEPS and len(learn):
        order = rng.permutation(learn)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            flat = np.concatenate([examples[i] for i in some])
            sizes = np.array([len(examples[i]) for i in some])
            starts = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(embed[flat], starts, axis=0) / sizes[:, None]
            z = mean @ weight + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            slope = z / z.sum(axis=1, keepdims=True)
            slope[np.arange(len(some)), gold[some]] -= 1
            rate = RATE * max(0.0, 1 - step / STEPS)
            down = (slope @ weight.T / sizes[:, None]).astype(np.float32)
            weight -= rate * (mean.T @ slope).astype(np.float32) / len(some)
            bias -= rate * slope.mean(axis=0).astype(np.float32)
            np.add.at(embed, flat, -rate * np.repeat(down, sizes, axis=0))
            step += 1
    logits = embed @ weight
    model = Model(languages, logits, bias, 0.0, 0.0, 0.0)
    check = np.flatnonzero(held) if held.any() else learn
    if len(check) == 0:
        return model
    mean = np.array([logits[examples[i]].mean(axis=0) for i in check])
    n = np.array([len(examples[i]) for i in check], float)
    best = None
    for power in np.linspace(0, 1, 11):
        for scale in np.linspace(-4, 3, 36):
            model.scale, model.power = float(scale), float(power)
            p = model.probabilities(mean, n)[np.arange(len(check)), gold[check]]
            loss = -np.log(np.maximum(p, 1e-9)).mean()
            if best is None or loss < best[0]:
                best = (loss, model.scale, model.power)
    _, model.scale, model.power = best
    p = model.probabilities(mean, n)
    score, right = p.max(axis=1), p.argmax(axis=1) == gold[check]
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION)
    model.threshold = float(score[order][good[-1]]) if len(good) else 1.0
    return model


class Words:
    """Sums of logits and counts of n-grams of distinct words, kept up to a bound."""

    def __init__(self, model: Model, limit: int = CACHE_WORDS):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages) + 1))

    def rows(self, words: list[str]) -> np.ndarray:
        """One row per word: its summed logits, and last its number of n-grams."""
        found = list(map(self.known.get, words))
        if None in found:
            new = [w for w, hit in zip(words, found) if hit is None]
            if len(self.known) + len(new) > self.limit:
                self.clear()
                new = words
            bucket, owner = buckets_of(new)
            first = len(self.known)
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for c in range(len(self.model.languages)):
                self.table[first : first + len(new), c] = np.bincount(owner, self.model.logits[bucket, c], len(new))
            self.table[first : first + len(new), -1] = np.bincount(owner, minlength=len(new))
            self.known.update(zip(new, range(first, first + len(new))))
            found = list(map(self.known.get, words))
        return self.table[found]


def predict(texts: list[str | None], words: Words) -> tuple[list[str], list[float], list[bool]]:
    model = words.model
    total = np.zeros((len(texts), len(model.languages) + 1))
    known = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        counts = Counter(WORDS.findall(text.lower())) if text else {}
        if counts and model.languages and has_letter(counts):
            known[i] = True
            total[i] = np.fromiter(counts.values(), float, len(counts)) @ words.rows(list(counts))
    if not known.any():
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
    n = total[:, -1]
    p = model.probabilities(total[:, :-1] / np.maximum(n, 1.0)[:, None], n)
    best, score = p.argmax(axis=1), p.max(axis=1)
    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
    return names, [float(s) if k else 0.0 for s, k in zip(score, known)], [bool(k and s >= model.threshold) for s, k in zip(score, known)]


def identify(text: Column, model: Model, spark) -> Column:
    """Struct (lang, score, accepted) of a text column."""
    shared = spark.sparkContext.broadcast(model)
    key = ("language", zlib.crc32(model.logits.tobytes()))

    @F.pandas_udf("lang string, score double, accepted boolean")
    def identified(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = worker_state(key, lambda: Words(shared.value))
        for batch in batches:
            lang, score, accepted = predict(list(batch), words)
            yield pd.DataFrame({"lang": lang, "score": score, "accepted": accepted})

    return identified(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """Texts and labels to learn from: of each language the ``per_language`` rows with the
    smallest hashes, and of each text ``chars`` characters.  Ids and hashes alone are ranked;
    Spark keeps the first of each group before it shuffles."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    keys = labelled.select("doc_id", "lang", F.xxhash64(F.col("doc_id"), F.lit(7)).alias("h"))
    few = keys.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    start = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    part = F.substring(F.col("text"), start.cast("int"), F.lit(chars))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("label"))
    rows = labelled.join(F.broadcast(few.distinct()), same).select("label", part.alias("part"))
    out = sorted((r.label, r.part) for r in rows.collect())
    return [t for _, t in out], [g for g, _ in out]


def language_report(docs: DataFrame) -> DataFrame:
    """Predicted language of every document; learned from the labels that are not held out."""
    docs = docs.select("doc_id", "text", "lang")
    model = train(*sample(docs))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(F.col("text"), model, docs.sparkSession).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.accepted").alias("accepted"))
