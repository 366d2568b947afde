"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration (operator 2).

Labelled rows whose crc32 of the id, as text, leaves 0 modulo 5 are held out and never learned from. Of the others
a bounded sample is used: remainders 1 to 3 give the lexicon and train the trees, remainder 4 calibrates them. The
lexicon is learned, not given: words, and starts of words, that are far more frequent in toxic rows. Every document is then
scored from its whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from brindle.llm.batches import slices, texts_of
from brindle.llm.shared import written

#: Bounds of what is learned from: labelled rows, and lexicon entries.
SAMPLE_ROWS, LEXICON_ENTRIES = 20_000, 2_000
#: Letters of a word start, and what an entry must have: toxic texts with it, as a number and as a share of all, and odds.
STEM, LEAST_TOXIC, LEAST_SHARE, LEAST_ODDS = 5, 3, 0.02, 12.0
#: What serves instead of the share: toxic texts, and by how many standard errors of their logarithm the odds must be higher.
SURE_TOXIC, ERRORS = 5, 1.645

#: Second-person words of the corpus' languages.
SECOND_PERSON = frozenset(
    w.encode() for w in "you your yours yourself yourselves du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
#: Characters that stand in for letters, and those letters.
DISGUISE = bytes.maketrans(b"013457@$!|", b"oieastasil")
PUNCTUATION = b".,;:?()[]{}<>\"'`~^&*+=-_/\\#%\n\t\r\x0b\x0c"
TO_SPACE = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
#: Letters, marks inside, letters; begun where letters begin only, so that a long word takes no more than its length.
MIXED = re.compile(rb"(?<![a-z])[a-z]++[013457@$!|*#.\-_]{1,3}[a-z]++", re.IGNORECASE)
FEATURES = ("word_density", "word_hits", "stem_density", "stem_hits", "near_second_person", "second_person", "capitals", "shouted", "exclamations", "punctuation", "obfuscated", "disguised_hits", "length")


@dataclass(frozen=True)
class Lexicon:
    words: frozenset[bytes]
    stems: frozenset[bytes]


def words_of(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(TO_SPACE).split()


def stem(word: bytes) -> bytes:
    return word.decode()[:STEM].encode()


def features(text: bytes, lexicon: Lexicon) -> list[float]:
    words = words_of(text)
    n, size = max(1, len(words)), max(1, len(text))
    clean = [w.rstrip(b"!") for w in words]
    hits = [i for i, w in enumerate(clean) if w in lexicon.words]
    stems = sum(1 for w in clean if w[:STEM] in lexicon.stems or (not w[:STEM].isascii() and stem(w) in lexicon.stems))
    veiled = [w.translate(DISGUISE) for w in words if not w.isalpha() and w.isascii()]
    disguised = sum(1 for w in veiled if w in lexicon.words) - sum(1 for w in words if w in lexicon.words and not w.isalpha() and w.isascii())
    second = [i for i, w in enumerate(clean) if w in SECOND_PERSON]
    near = 0
    if hits and second:
        at = np.searchsorted(second, hits)
        where = np.array([-(10**9), *second, 10**9])
        near = int(((hits - where[at] <= 5) | (where[at + 1] - hits <= 5)).sum())
    letters = len(text.translate(None, bytes(range(65)) + bytes(range(91, 97)) + bytes(range(123, 256))))
    upper = len(text.translate(None, bytes(range(65)) + bytes(range(91, 256))))
    shouted = sum(1 for w in text.split() if w.isupper() and len(w) > 3)
    marks = text.count(b"!")
    return [
        len(hits) / n, min(len(hits), 20), stems / n, min(stems, 20), near / n, len(second) / n, upper / max(1, letters), shouted / n,
        marks / size, (len(text) - len(text.translate(None, PUNCTUATION))) / size, len(MIXED.findall(text)) / n, min(disguised, 20), math.log1p(len(words)),
    ]


def with_features(rows: DataFrame, lexicon: Lexicon, text: str, keep: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                found = [features(t, held) for t in texts_of(part.column(part.num_columns - 1))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.list_(pa.float64()))], [*keep, "_features"])

    schema = StructType([*rows.select(*keep).schema.fields, StructField("_features", ArrayType(DoubleType()))])
    return rows.select(*keep, text).mapInArrow(run, schema).withColumn("_features", array_to_vector("_features"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and word starts whose odds are LEAST_ODDS times higher in toxic texts; at most LEXICON_ENTRIES.

    Copies count once, and an entry must be in many toxic texts, or have odds whose lower bound suffices: else the rare words of
    a few texts would pass. What the bound asks for does not grow with the sample.
    """
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, entries = [], []
            for t, label in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = {w.rstrip(b"!") for w in words_of(t)} - {b""}
                found = {b"w" + w for w in words} | {b"s" + stem(w) for w in words if len(w.decode()) >= STEM}
                entries += found
                toxic += [label] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.binary()), pa.array(toxic, pa.int32())], ["entry", "toxic"])

    counted = rows.select("text", "toxic").mapInArrow(run, "entry binary, toxic int").groupBy("entry").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    sizes = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)).alias("good")).first()
    odds = (F.col("bad") + 0.5) / (sizes["bad"] + 1.0) * (sizes["good"] + 1.0) / (F.col("good") + 0.5)
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    sure = (F.col("bad") >= SURE_TOXIC) & (odds * F.exp(-ERRORS * error) >= LEAST_ODDS)
    best = counted.where(((F.col("bad") >= max(LEAST_TOXIC, LEAST_SHARE * sizes["bad"])) | sure) & (odds >= LEAST_ODDS)).orderBy((odds * F.log1p("bad")).desc(), "entry").limit(LEXICON_ENTRIES).select("entry").collect()
    found = [bytes(r["entry"]) for r in best]
    return Lexicon(frozenset(e[1:] for e in found if e[:1] == b"w"), frozenset(e[1:] for e in found if e[:1] == b"s"))


def fold(id_column: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(5))


@dataclass(frozen=True)
class Model:
    """What scores a text: a lexicon for its features, trees over these, and the curve that makes the trees' margin a probability."""

    lexicon: Lexicon
    trees: GBTClassificationModel
    curve: IsotonicRegressionModel


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learns from labelled documents that are not held out, at most about ``sample_rows``; None where they lack a class."""
    train = labels.where(F.col("toxic").isNotNull() & F.col(id_column).isNotNull() & (fold(id_column) != 0)).groupBy(id_column).agg(F.max("toxic").alias("toxic"))
    # The share that keeps the sample near its bound is even over ids, whatever their order.
    share = min(1.0, sample_rows / max(1, train.count()))
    chosen = train.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 53)).cast("double") < share * (1 << 53)).select(F.col(id_column).alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    # At most sample_rows ids, but for chance: small enough to broadcast.
    rows = written(docs.join(F.broadcast(chosen), F.col(id_column) == F.col("_id")).select(fold(id_column).alias("fold"), "toxic", F.coalesce(F.col(text), F.lit("")).alias("text")))
    classes = {r["toxic"] for r in rows.select("toxic").distinct().collect()}
    if len(classes & {0, 1}) < 2:
        return None
    lexicon = learn_lexicon(rows.where("fold <> 4"))
    learned = with_features(rows, lexicon, "text", ["fold", "toxic"]).withColumn("label", F.col("toxic").cast("double")).repartition(4).persist()
    both = lambda x: x.select("toxic").distinct().count() == 2
    fitted, rest = learned.where("fold <> 4"), learned.where("fold = 4")
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, maxBins=32, seed=7).fit(fitted if both(fitted) else learned)
    curve = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_curve").fit(with_margin(rest if both(rest) else learned, trees).select("_margin", "label"))
    learned.unpersist()
    return Model(lexicon, trees, curve)


def with_margin(rows: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    return trees.transform(rows).withColumn("_margin", vector_to_array("rawPrediction")[1])


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) of each document, and columns ``keep`` of it.

    Labels that are null or of no document are not used; an id labelled twice counts as toxic if one label says so.
    Where the sample lacks a class all scores are 0. Null and empty texts get the score of their features, all 0. A null id is in
    fold crc32('') mod 5 = 0, held out. Repeated rows stay; other columns are not read; a name in ``keep`` that the result has already is an error; empty tables give no row.
    """
    return scored(docs, fit(docs, labels, id_column, text, sample_rows), id_column, text, keep)


def scored(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents with the scores of a model, or of 0 without one; see ``toxicity``."""
    if clash := {*keep} & {"held_out", "score", "predicted"}:
        raise ValueError(f"the result has columns of its own named {', '.join(sorted(clash))}")
    # Kept columns travel as one, so that none has a name used here.
    source = docs.select(F.col(id_column).alias("_id"), F.struct(F.lit(0).alias("_"), *(F.col(c) for c in keep)).alias("_row"), F.col(text).alias("_text"))
    held = (fold("_id") == 0).alias("held_out")
    out = [F.col("_id").alias(id_column), *(F.col("_row")[c].alias(c) for c in keep if c != id_column)]
    if model is None:
        return source.select(*out, held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    rows = model.curve.transform(with_margin(with_features(source, model.lexicon, "_text", ["_id", "_row"]), model.trees))
    # The curve is flat in places; the trees' own order breaks its ties, by a hundredth at most.
    score = 0.99 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_curve"))) + 0.01 / (1 + F.exp(-2 * F.col("_margin")))
    rows = rows.withColumn("_score", score)
    return rows.select(*out, held, F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
