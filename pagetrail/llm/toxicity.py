"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled rows, then trees are fitted to densities of it, its nearness to second
persons, capitals, punctuation and obfuscation. Fitting uses a bounded sample of labelled rows; scoring covers every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, text_or_empty

#: Labelled rows that the fit uses at most, taken in hash order of their ids.
TRAIN_ROWS = 20_000
#: Terms that the lexicon holds at most, and toxic texts that a term must be in.
LEXICON = 512
LEAST = 5
#: Lower bound (z = 2.6) of the share of toxic texts among those with a term.
SHARE = 0.5
PREFIXES = (4, 5, 6)
#: Tokens whose codes, or terms whose counts, a worker holds.
MEMO = 150_000

# Second-person words, and characters that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})

FEATURES = ("log_words", "hits", "density", "weight_density", "most", "distinct", "near_second", "second_rate", "hidden_hits", "capitals", "shouted", "exclaims", "questions", "symbols", "obfuscated", "stretched")

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INSIDE = re.compile(r"[^\W\d_]")
_STRETCH = re.compile(r"(\w)\1\1")
_CAPS = bytes(range(65, 91))
_LETTERS = _CAPS + bytes(range(97, 123))
_MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def plain(token: str) -> tuple[str, str]:
    """A lower-case token without the marks around it, and the same with stand-in characters read as letters and inner marks gone."""
    if token.isalpha():
        return token, token
    inner = token.strip(".,;:?\"'()")
    if inner.isalpha():  # as the rest of this function would have it
        return inner, inner
    return _EDGE.sub("", token), "".join(c for c in inner.translate(LEET) if c.isalpha())


def terms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)] if word else []


class Featuriser:
    """Feature vectors of texts. Each distinct token is looked at once: its code packs what the features need."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.memo = lexicon, {}
        self.order = {t: i for i, t in enumerate(sorted(lexicon))}

    def code(self, token: str) -> tuple[float, int, bool, bool, bool, bool]:
        core, clear = plain(token)
        found = [t for t in terms(core) if t in self.lexicon]
        hidden = not found and clear != core
        if hidden:
            found = [t for t in terms(clear) if t in self.lexicon]
        best = max(found, key=lambda t: (self.lexicon[t], t), default=None)
        mixed = not core.isalpha() and bool(core) and not core.isdigit() and bool(_INSIDE.search(core)) and core.translate(LEET).isalpha()
        return (self.lexicon[best] if best else 0.0, self.order[best] if best else -1, hidden and best is not None, core in SECOND_PERSON, mixed, bool(_STRETCH.search(core)))

    def __call__(self, text: str) -> list[float]:
        raw = text.encode()
        tokens = text.lower().split()
        n = len(tokens)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        for t in set(tokens).difference(memo):
            c = self.code(t)
            memo[t] = c if c[0] or any(c[2:]) else None
        told = [(i, c) for i, c in enumerate(map(memo.__getitem__, tokens)) if c is not None]
        hits = [(i, c) for i, c in told if c[0]]
        seconds = np.array([i for i, c in told if c[3]])
        near = 0.0
        if hits and len(seconds):
            at = np.array([i for i, _ in hits])
            j = np.searchsorted(seconds, at)
            gap = np.minimum(np.abs(at - seconds[np.maximum(j - 1, 0)]), np.abs(seconds[np.minimum(j, len(seconds) - 1)] - at))
            near = float((1 / (1 + gap)).max())
        letters = len(raw) - len(raw.translate(None, _LETTERS))
        caps = len(raw) - len(raw.translate(None, _CAPS))
        words, size, weight = max(n, 1), max(len(raw), 1), sum(c[0] for _, c in hits)
        return [math.log1p(n), math.log1p(len(hits)), len(hits) / words, weight / words, max((c[0] for _, c in hits), default=0.0), float(len({c[1] for _, c in hits})), near, len(seconds) / words,
                float(sum(c[2] for _, c in hits)), caps / max(letters, 1), float(caps > 0.5 * letters > 5), raw.count(b"!") / size, raw.count(b"?") / size,
                (len(raw) - len(raw.translate(None, _MARKS))) / size, sum(c[4] for _, c in told) / words, sum(c[5] for _, c in told) / words]


def features(text: Column, lexicon: dict[str, float]) -> Column:
    """An array of FEATURES for every whole text."""

    @F.pandas_udf("array<double>")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = Featuriser(lexicon)
        for b in batches:
            yield pd.Series([f(t) for t in b])

    return compute(text)


def remainder(id_col: Column) -> Column:
    """crc32 of the id's decimal text, mod 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def _family(text: str) -> int:
    """The smallest hash of the text's three-word runs: near copies mostly share it."""
    w = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1


def learn_lexicon(sample: DataFrame, *, most: int = LEXICON, least: int = LEAST, share: float = SHARE) -> dict[str, float]:
    """Terms (words, and beginnings written ``begi-``) that labelled toxic texts have and others hardly, with their log odds.

    One text of each family of near copies counts. Counts are added up in Spark; the driver gets ``most`` terms at most.
    """

    def told(seen: Counter, toxic: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64()), pa.array([toxic[t] for t in seen], pa.int64())], ["term", "n", "k"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column("text"), b.column("label"), strict=True):
                found = {t for w in set(text.as_py().lower().split()) for p in set(plain(w)) for t in terms(p)}
                seen.update(found)
                if label.as_py():
                    toxic.update(found)
                if len(seen) > MEMO:
                    yield told(seen, toxic)
                    seen, toxic = Counter(), Counter()
        yield told(seen, toxic)

    counted = small_batches(sample).select("text", "label").mapInArrow(count, "term string, n long, k long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    z, p = 2.6, F.col("k") / F.col("n")
    low = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    best = counted.where(F.col("k") >= least).withColumn("low", low).where(F.col("low") >= share).orderBy(F.desc("low"), F.desc("k"), "term").limit(most)
    return {r["term"]: math.log((r["k"] + 0.5) / (r["n"] - r["k"] + 0.5)) for r in best.collect()}


class ToxicityModel:
    """A fitted lexicon, trees and calibration; ``trees`` is None where the labels had fewer than LEAST rows of a class."""

    def __init__(self, lexicon: dict[str, float], trees, calibration, base: float) -> None:
        self.lexicon, self.trees, self.calibration, self.base = lexicon, trees, calibration, base

    def score(self, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
        """``docs`` as a struct ``_row`` with ``score``, the calibrated probability. Null texts count as empty and are scored like them."""
        rows = small_batches(docs).select(F.struct("*").alias("_row"))
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.base))
        vectors = rows.withColumn("_x", array_to_vector(features(text_or_empty(F.col("_row")[text_col]), self.lexicon)))
        told = _raw(self.trees, vectors)
        told = self.calibration.transform(told)
        return told.select("_row", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_iso"))).alias("score"))


def _raw(trees, vectors: DataFrame) -> DataFrame:
    return trees.transform(vectors).withColumn("_raw", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, seed: int = 7) -> ToxicityModel:
    """Learn from labelled rows whose crc32(id) mod 5 is not 0, ``rows`` of them at most, the first in hash order of their ids.

    Rows without a label, text or id teach nothing. Families of near copies are dealt to five folds: four give a lexicon and trees, and
    the fifth, which they have not seen, their calibration. Lexicon and trees are then learned again from all five. With fewer than LEAST rows of either class in the four there is no fit and every
    score is the share of toxic rows (0 without labels).
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("label"))
    known = known.where(remainder(F.col("_id")) != 0).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(known), "_id")  # at most ``rows`` short rows

    small_batches(docs)

    @F.pandas_udf("long")
    def family(text: pd.Series) -> pd.Series:
        return text.map(_family)

    sample = cut(sample.withColumn("_family", family("text")).withColumn("_fold", F.pmod(F.xxhash64("_family", F.lit(seed)), F.lit(5))))
    told = {r["fit"]: r for r in sample.groupBy((F.col("_fold") != 0).alias("fit")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).collect()}
    n, toxic = (sum(r[c] for r in told.values()) for c in ("n", "toxic"))
    base = toxic / n if n else 0.0
    if len(told) < 2 or min(told[True]["toxic"], told[True]["n"] - told[True]["toxic"]) < LEAST:
        return ToxicityModel({}, None, None, base)
    lexicon, trees, rest = _trees(sample, F.col("_fold") != 0, seed)
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_iso").fit(_raw(trees, rest).select("_raw", "label"))
    lexicon, trees, _ = _trees(sample, F.lit(True), seed)
    return ToxicityModel(lexicon, trees, calibration, base)


def _trees(sample: DataFrame, fit: Column, seed: int) -> tuple[dict[str, float], object, DataFrame]:
    """Lexicon and trees from the rows for which ``fit`` holds, and the vectors of the others."""
    sample = sample.withColumn("_fit", fit)
    lexicon = learn_lexicon(sample.where("_fit").groupBy("_family").agg(F.min_by("text", "_id").alias("text"), F.min_by("label", "_id").alias("label")))
    vectors = cut(sample.select(F.col("label").cast("double").alias("label"), "_fit", features(F.col("text"), lexicon).alias("_x"))).withColumn("_x", array_to_vector("_x"))
    trees = GBTClassifier(featuresCol="_x", labelCol="label", maxDepth=4, maxIter=12, stepSize=0.3, seed=seed).fit(vectors.where("_fit"))
    return lexicon, trees, vectors.where("not _fit")


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; ``held_out`` rows taught nothing.

    Null texts count as empty. Rows with equal texts have equal scores. An empty table gives an empty result; extra columns, whatever
    their names, play no part.
    """
    told = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **fit).score(docs.select(id_col, text_col), text_col=text_col)
    doc = F.col("_row")[id_col]
    return told.select(doc.alias("doc_id"), (remainder(doc) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", **fit) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, as they were; edge cases as in :func:`score_toxicity`. Other columns are passed on."""
    return fit_toxicity(docs, labels, text_col=text_col, **fit).score(docs, text_col=text_col).where("score < 0.5").select("_row.*")
