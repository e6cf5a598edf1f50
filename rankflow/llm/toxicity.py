"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned: words that stand in clearly more toxic than other training texts, by
smoothed log odds of document frequencies, at most `LEXICON` words. Features are the density,
spread and concentration of its words, their nearness to the second person (fixed pronouns of
four languages), capitals, punctuation, and obfuscation: letters swapped for look-alikes, marks
inside a word, letters spaced out, letters repeated. The same Python helper reads a training text
and a scored one, whole. Labels are read from training rows only; folds 1 to 3 of crc32(doc_id)
fit the lexicon and the trees, fold 4 the calibration, fold 0 is held out. About
`trees.MOST_LABELLED` training rows are used; label, language, source and doc_id are no features.

Null and empty texts have all features 0 and get a score. Labels without a doc_id or a label are
left out; a doc_id that repeats among labels or documents counts each time. Without labels of both
kinds the score is the share of toxic training rows, or 0. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankflow.llm import trees
from rankflow.llm.common import by_batch, fold_of
from rankflow.session import cut, store

STEM = 5
LEXICON, LEAST_TEXTS, LEAST_ODDS = 200, 5, 1.5
NEAR, STRETCH = 5, 50
# Second person pronouns and look-alikes.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch tu te toi ton ta tes vous votre vos tú ti tu tus usted ustedes".split()
)
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
_EDGE = ".,;:!?\"'()[]{}<>«»“”„…-–—"
_INNER = re.compile(r"[.*_\-'’#+~]")
_LONG = re.compile(r"(.)\1{2,}")
_TOKEN_SQL = r"[^\p{L}\p{M}\p{N}'’]+"

FEATURES = [
    "log_words", "lexicon_density", "lexicon_log_count", "lexicon_kinds", "lexicon_weight", "lexicon_peak", "stem_density", "stem_log_count", "second_density", "near_second",
    "capitals", "capital_words", "exclamations", "questions", "punctuation", "obfuscated", "obfuscated_log_count", "spaced_letters", "long_letters", "digits_in_words",
]


def plain_form(token: str) -> str:
    """A token's letters without look-alikes, inner marks and repetitions."""
    return _LONG.sub(r"\1", _INNER.sub("", token.translate(LOOKALIKES)))


def features_of(text: str | None, lexicon: dict[str, float]) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    tokens = text.split()
    n = len(tokens)
    words = [t.strip(_EDGE) for t in text.lower().split()]
    hits, weights, kinds, obscured, second, spaced, single = [], 0.0, set(), 0, [], 0, []
    inside = stems = 0

    def spelled() -> int:
        return int(len(single) >= 3 and "".join(single) in lexicon)

    for i, w in enumerate(words):
        if len(w) == 1:
            single.append(w)
            if w in SECOND_PERSON:
                second.append(i)
            continue
        if single:
            spaced += spelled()
            single = []
        if w in lexicon:
            found = w
        elif w.isalpha() and tokens[i][0] not in "!|" and not _LONG.search(w):
            found = ""
        else:
            inside += any(c.isdigit() for c in w) and any(c.isalpha() for c in w)
            form = plain_form(w)
            found = form if form in lexicon else ""
            if not found:  # marks at the edges may be look-alikes too
                form = plain_form(tokens[i].lower()).strip(_EDGE)
                found = form if form in lexicon else ""
            obscured += bool(found)
        stems += len(w) > STEM and w[:STEM] + "*" in lexicon
        if found:
            hits.append(i)
            kinds.add(found)
            weights += lexicon[found]
        elif w in SECOND_PERSON:
            second.append(i)
    spaced += spelled()
    n = max(n, 1)
    at, seen = np.array(hits, dtype=np.int64), np.array(second, dtype=np.int64)
    near = peak = 0
    if len(at):
        peak = int((np.searchsorted(at, at + STRETCH) - np.arange(len(at))).max())
        if len(seen):
            near = int((np.searchsorted(seen, at + NEAR, "right") > np.searchsorted(seen, at - NEAR)).sum())
    letters = sum(map(str.isalpha, text)) or 1
    shouted = sum(len(t) > 2 and t.isupper() for t in tokens)
    return [
        math.log1p(n), 100 * len(hits) / n, math.log1p(len(hits)), float(len(kinds)), 100 * weights / n, float(peak), 100 * stems / n,
        math.log1p(stems), 100 * len(second) / n,
        100 * near / n, sum(map(str.isupper, text)) / letters, 100 * shouted / n, 100 * text.count("!") / n, 100 * text.count("?") / n,
        100 * (text.count(",") + text.count(".")) / n, 100 * obscured / n, math.log1p(obscured), float(spaced), 100 * len(_LONG.findall(text)) / n, 100 * inside / n,
    ]


def measure(rows: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """`keep` and the features of `text`."""
    told = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep), *(f"{f} double" for f in FEATURES)])
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)  # at most LEXICON words

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = shared.value
        made = np.array([features_of(t, words) for t in batch.column("text").to_pylist()], dtype=np.float64).T
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, made)], [*keep, *FEATURES])

    return by_batch(rows.select(*dict.fromkeys([*keep, "text"])), work, told)


def learn_lexicon(rows: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Word -> log odds, from rows of text and toxic; counted in Spark, at most `most` words come back."""
    total = rows.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    if not total.bad or not total.good:
        return {}
    tokens = F.array_distinct(F.split(F.lower("text"), _TOKEN_SQL))
    stems = F.transform(F.filter(tokens, lambda w: F.length(w) > STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*")))
    found: dict[str, float] = {}
    for entries in (tokens, F.array_distinct(stems)):
        counts = rows.select("toxic", F.explode(entries).alias("word")).where("length(word) > 2").groupBy("word").agg(
            F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
        )
        odds = F.log((F.col("bad") + 0.5) / (total.bad + 1.0)) - F.log((F.col("good") + 0.5) / (total.good + 1.0))
        clear = counts.where(F.col("bad") >= LEAST_TEXTS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
        best = clear.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "word").limit(most).collect()
        found |= {r.word: float(r.odds) for r in best if r.word not in SECOND_PERSON}
    return found


class ToxicityModel:
    def __init__(self, documents: DataFrame, labels: DataFrame):
        fold = fold_of("doc_id")
        known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"), fold.alias("fold")
        )
        drawn = cut(trees.bounded(known.where("fold != 0"), F.col("doc_id")))  # bounded, hence broadcast
        texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        rows = store(texts.join(F.broadcast(drawn), "doc_id"), "toxicity")
        fitting = rows.where("fold < 4")
        self.lexicon = learn_lexicon(fitting)
        measured = store(measure(rows, self.lexicon, ["toxic", "fold"]), "toxicity")
        self.scorer = trees.fit(measured.where("fold < 4"), FEATURES, "toxic")
        self.scorer.calibrate(measured.where("fold = 4"), "toxic")

    def score(self, documents: DataFrame) -> DataFrame:
        """doc_id and score of every row."""
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return self.scorer.score(measure(rows, self.lexicon, ["doc_id"])).select("doc_id", "score")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = ToxicityModel(documents, labels).score(documents)
    return scored.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
