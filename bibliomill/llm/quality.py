"""Quality rules from tokeniser fertility.

A public vocabulary cuts each word of a text into pieces.  Text of the kind the vocabulary
was made for needs few pieces per letter; symbol noise, tables of separators and broken
encodings need many, fall back to bytes, or repeat the same few pieces.  Three measures say
so: letters and digits per piece, share of byte pieces, and entropy of the pieces.  What is
usual differs by language and length, so every band comes from the whole corpus:

* letters per piece: the median of the language; its deviation falls with the root of the
  length, so the distance is counted in median deviations times that root;
* entropy: the median of the language and length class (half an octave of words), distance
  counted in the same way;
* a text is rejected when both distances together lie ``DEVIATIONS`` below the band.  A text
  in two languages has more pieces than usual but also more entropy, and stays;
* byte pieces: ``MAX_EXTRA_BYTES`` above the median share of the language.

Texts without a language take the bands of their script.

Defined cases: a null or empty text has no words, fails the base rules and is rejected;
repeated rows are judged alike; a class of a single text is its own median, so only its
letters per piece can reject it; an empty table gives an empty result.  Other columns are
kept, whatever their names.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliomill.llm.common import broadcast_up_to, cut_lineage, free_name, worker_state

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
DEVIATIONS = 5.0
MAX_EXTRA_BYTES = 0.1
# No language is so even that less than this is a deviation (times the root of the length).
LEAST_DEVIATION = 0.2
CACHE_WORDS = 500_000
# Bands of languages and classes are small; more rows than this are joined by shuffling.
BROADCAST_BANDS = 100_000
# So many rejected documents (16 bytes each) are sent to all executors; more are shuffled.
BROADCAST_REJECTED = 1_000_000

METRICS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("chars_per_token", T.DoubleType()),
        T.StructField("byte_share", T.DoubleType()),
        T.StructField("token_entropy", T.DoubleType()),
        T.StructField("script", T.StringType()),
    ]
)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Pieces of distinct words, each cut once and kept up to a bound."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.limit = limit
        self.known: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> list[bytes]:
        """For each word its count of letters and digits, then its piece numbers, as 32-bit integers."""
        found = list(map(self.known.get, words))
        if None not in found:
            return found
        new = [w for w, hit in zip(words, found) if hit is None]
        texts = [w.decode("utf-8", "replace") for w in new]
        cut = self.model.encode(texts, num_threads=1)
        made = {w: array("i", [sum(map(str.isalnum, t)), *ids]).tobytes() for w, t, ids in zip(new, texts, cut)}
        if len(self.known) + len(made) > self.limit:
            self.known.clear()
        self.known.update(made)
        return [made[w] if hit is None else hit for w, hit in zip(words, found)]


def repeated_positions(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of eight words found twice or more, by exact ranks: two
    windows get the same number only if all their words are the same."""
    assert window == 8
    n = len(ids) - window + 1
    if n < 2:
        return 0
    codes = ids.astype(np.int64)
    for step in (1, 2, 4):
        base = np.int64(codes.max()) + 1
        codes = codes[:-step] * base + codes[step:]
        if step < 4:
            codes = np.unique(codes, return_inverse=True)[1]
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def script_of(text: str) -> str:
    """First word of the Unicode name most letters of the text carry, such as LATIN."""
    names: Counter[str] = Counter()
    for char, n in Counter(text).items():
        if char.isalpha():
            names[unicodedata.name(char, "UNKNOWN").split(" ")[0]] += n
    return min(names, key=lambda k: (-names[k], k)) if names else "NONE"


def measure(text: str | None, lang: str | None, pieces: Pieces) -> tuple:
    """All measures of one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    counts = Counter(words)
    # UTF-8 continuation bytes never count as white space, so they all lie in words
    data = np.frombuffer(raw, np.uint8)
    word_chars = len(raw.translate(None, b" \t\n\r\v\f")) - int(np.count_nonzero((data & 0xC0) == 0x80))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\r\v\f")]
    dup_lines = len(lines) - len(set(lines))
    repeats = n_tokens = n_bytes = letters = 0
    entropy = 0.0
    if words:
        number = dict(zip(counts, range(len(counts))))
        repeats = repeated_positions(np.array([number[w] for w in words]))
        cut = pieces.of(list(counts))
        sizes = np.array(list(map(len, cut))) // 4
        tokens = np.frombuffer(bytearray(b"".join(cut)), np.int32)
        times = np.array(list(counts.values()))
        heads = np.cumsum(sizes) - sizes
        letters = int(times @ tokens[heads])
        weight = np.repeat(times, sizes)
        weight[heads] = tokens[heads] = 0
        n_tokens = int(weight.sum())
        n_bytes = int(weight[pieces.is_byte[tokens]].sum())
        share = np.bincount(tokens, weight)
        share = share[share > 0] / n_tokens
        entropy = float(-(share * np.log2(share)).sum())
    return (
        len(words), word_chars, symbols, dup_lines, repeats, n_tokens,
        letters / n_tokens if n_tokens else 0.0, n_bytes / n_tokens if n_tokens else 0.0, entropy,
        script_of(text or "") if lang is None else None,
    )


def metrics(text: Column, lang: Column, path: str | None = None) -> Column:
    """Struct of all measures of a text column, computed in Arrow batches."""
    path = path or vocabulary_path()

    @F.pandas_udf(METRICS)
    def measured(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pieces = worker_state(("pieces", path), lambda: Pieces(path))
        for texts, langs in batches:
            yield pd.DataFrame([measure(t, g, pieces) for t, g in zip(texts, langs)], columns=METRICS.names)

    return measured(text, lang)


def base_failed(m: Column) -> Column:
    return (m.n_words < MIN_WORDS) | (F.lit(100) * m.n_repeat_words > F.lit(MAX_REPEAT_PERCENT) * m.n_words)


def _median(x: Column) -> Column:
    return F.percentile_approx(x, 0.5, 1000)


def verdicts(measured: DataFrame, m: str, lang: str, out: str) -> DataFrame:
    """``measured`` with the boolean column ``out``.

    ``measured`` should be a written table: it is read once for each of the three passes
    that set the bands, which move numbers only, and once for the result.
    """
    col = F.col(m)
    language = F.coalesce(F.concat(F.lit("language:"), F.col(lang)), F.concat(F.lit("script:"), col.script), F.lit("none"))
    classed = F.floor(F.lit(2) * F.log2(F.greatest(col.n_words, F.lit(1)).cast("double"))).cast("int")
    rows = measured.where(~base_failed(col)).select(
        language.alias("language"), classed.alias("class"), F.sqrt(col.n_words.cast("double")).alias("root"),
        col.chars_per_token.alias("cpt"), col.byte_share.alias("bytes"), col.token_entropy.alias("entropy"),
    )
    by_language = rows.groupBy("language").agg(_median(F.col("cpt")).alias("mid_cpt"), _median(F.col("bytes")).alias("mid_bytes"))
    by_language = broadcast_up_to(cut_lineage(by_language, "bands"), BROADCAST_BANDS)
    by_class = rows.groupBy("language", "class").agg(_median(F.col("entropy")).alias("mid_entropy"))
    by_class = broadcast_up_to(cut_lineage(by_class, "bands"), BROADCAST_BANDS)
    spread = (
        rows.join(by_language, "language")
        .join(by_class, ["language", "class"])
        .groupBy("language")
        .agg(
            F.greatest(_median(F.abs(F.col("cpt") - F.col("mid_cpt")) * F.col("root")), F.lit(LEAST_DEVIATION)).alias("dev_cpt"),
            F.greatest(_median(F.abs(F.col("entropy") - F.col("mid_entropy")) * F.col("root")), F.lit(LEAST_DEVIATION)).alias("dev_entropy"),
        )
    )
    k, b = free_name(measured, "band"), free_name(measured, "class_band")
    whole = broadcast_up_to(cut_lineage(by_language.join(spread, "language"), "bands"), BROADCAST_BANDS)
    per_language = whole.select(F.struct("*").alias(k))
    per_class = by_class.select(F.struct("*").alias(b))
    judged = measured.join(per_language, language == F.col(f"{k}.language"), "left").join(
        per_class, (language == F.col(f"{b}.language")) & (classed == F.col(f"{b}.class")), "left"
    )
    root = F.sqrt(col.n_words.cast("double")) / F.lit(1.4826)
    distance = ((col.chars_per_token - F.col(f"{k}.mid_cpt")) / F.col(f"{k}.dev_cpt") + (col.token_entropy - F.col(f"{b}.mid_entropy")) / F.col(f"{k}.dev_entropy")) * root
    usual = (distance >= -DEVIATIONS) & (col.byte_share <= F.col(f"{k}.mid_bytes") + MAX_EXTRA_BYTES)
    return judged.withColumn(out, F.when(base_failed(col), False).otherwise(F.coalesce(usual, F.lit(True)))).drop(k, b)


def judged(docs: DataFrame, *keys: Column) -> DataFrame:
    """The keys of every document with its measures (``fertility``) and verdict (``kept``).
    The measures, not the texts, are written to the shared folder, because the bands need all
    of them before the first can be judged."""
    m = "fertility"
    narrow = docs.select(*keys, F.col("lang").alias("lang"), metrics(F.col("text"), F.col("lang")).alias(m))
    return verdicts(cut_lineage(narrow, "fertility"), m, "lang", "kept")


def quality_report(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document, without the texts."""
    m = F.col("fertility")
    base = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    more = [m[c].alias(c) for c in ("n_tokens", "chars_per_token", "byte_share", "token_entropy")]
    return judged(docs, F.col("doc_id")).select("doc_id", *base, base_failed(m).alias("base_failed"), "kept", *more)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass the base rules and the bands.

    Rejected rows are told by id and a hash of text and language, which is all the verdict
    depends on; few of them travel to the texts, many are joined by shuffling.
    """
    rejected, print_ = free_name(docs, "rejected_id"), free_name(docs, "rejected_print")
    content = F.xxhash64("text", "lang")
    verdict = judged(docs, F.col("doc_id").alias(rejected), content.alias(print_))
    bad = cut_lineage(verdict.where("NOT kept").select(rejected, print_).distinct(), "rejected")
    same = F.col("doc_id").eqNullSafe(F.col(rejected)) & (content == F.col(print_))
    return docs.join(broadcast_up_to(bad, BROADCAST_REJECTED), same, "left_anti")
