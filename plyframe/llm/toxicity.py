"""Toxicity: gradient-boosted trees over dense features of the text, calibrated by isotonic regression.

Features: densities of a lexicon (a short seed list and a lexicon of words and word beginnings learned from the labels),
nearness of its hits to second-person words, rates of capitals, punctuation and obfuscated words, and the length.  Labels
are learned from a bounded, documented sample of the labelled rows outside the held-out fold (`train_rows`, by hash of the
id), in three parts: lexicon, trees, calibration.  No column but the text enters a score.

Defined cases: a null or empty text is scored by its (zero) features; several labels of one id count as the highest;
rows without label or id teach nothing; without labels of both kinds every score is the share of toxic labels;
repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, in_arrow, slices
from .textbytes import BLANK, LOWER, hash_spans, mix, pieces, spans, utf8

#: Common insults, and second-person words, of English, French, German and Spanish.
INSULTS = (
    "idiot idiots stupid moron morons dumb fool trash garbage loser losers pathetic scum worthless disgusting clown jerk imbecile "
    "connard connasse salaud crétin abruti débile dumm dummkopf trottel arschloch schwachkopf estúpido idiota imbécil basura tonto"
)
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes tus ti contigo vosotros"

BEGINNINGS = (4, 5, 6)
_WORDS = np.zeros(256, np.uint8)
_WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip("013457@$!", "oieastasi", strict=True):
    _LEET[ord(_a)] = ord(_b)
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
N_FEATURES = 16


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(5)) == 0, F.lit(False))


def entries(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings of some lengths in bytes (0 where the word is shorter)."""
    out = [hash_spans(low, begin, end)]
    for n in BEGINNINGS:
        long = end - begin > n
        h = np.zeros(len(begin), np.uint64)
        h[long] = mix(hash_spans(low, begin[long], begin[long] + n) + np.uint64(n))
        out.append(h)
    return out


def hash_words(text: str) -> np.ndarray:
    data, offsets = utf8(pa.array([text]))
    return hash_spans(LOWER[data], *spans(LOWER[data], offsets, _WORDS))


@dataclass(frozen=True)
class Lexicon:
    """Sorted entry hashes and their weights; a table of 2^16 flags answers most look-ups."""

    keys: np.ndarray
    weights: np.ndarray
    flags: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, weights: np.ndarray) -> Lexicon:
        order, flags = np.argsort(keys), np.zeros(1 << 16, bool)
        flags[(keys >> np.uint64(48)).astype(np.int64)] = True
        return Lexicon(keys[order], weights[order], flags)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The weight of each hash, 0 for those not in the lexicon."""
        out = np.zeros(len(h))
        at = np.flatnonzero(self.flags[(h >> np.uint64(48)).astype(np.int64)])
        if len(at) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[place] == h[at], self.weights[place], 0)
        return out


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """(texts, N_FEATURES) of the whole texts."""
    data, offsets = utf8(column)
    n, you = len(offsets) - 1, np.sort(hash_words(SECOND_PERSON))
    seeds = np.sort(hash_words(INSULTS))
    sums = np.zeros((n, 12))  # words, hits, weight, seed hits, you, near hits, capitals, letters, all-caps words, signs, bangs, odd words
    top, nearest = np.zeros(n), np.full(n, 50.0)
    for a, b in pieces(data, offsets):
        raw = data[a:b]
        low = LOWER[raw]
        inner = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
        begin, end = spans(low, inner, _WORDS)
        at = np.searchsorted(offsets, begin + a, "right") - 1
        hashes = entries(low, begin, end)
        weight = np.max([lexicon.look_up(h) for h in hashes], axis=0)
        tokens = spans(raw, inner)  # blank-separated: odd ones mix letters with digits or signs inside
        t_at = np.searchsorted(offsets, tokens[0] + a, "right") - 1
        total = lambda flag: np.concatenate([[0], np.cumsum(flag)])
        alpha, upper, digit = total(_ALPHA[raw]), total(_UPPER[raw]), total(_DIGIT[raw])
        count = lambda c, s: c[s[1]] - c[s[0]]
        inside = (tokens[0] + 1, np.maximum(tokens[1] - 2, tokens[0] + 1))
        odd = (count(alpha, tokens) > 0) & (inside[1] - inside[0] > count(alpha, inside)) & (tokens[1] - tokens[0] > 3)
        plain = hash_spans(_LEET[low], *tokens) if odd.any() else None
        leet = np.isin(plain[odd], np.concatenate([seeds, lexicon.keys])) if odd.any() else np.zeros(0, bool)
        seed, second = np.isin(hashes[0], seeds), np.isin(hashes[0], you)
        hit = (weight > 0) | seed
        place = np.arange(len(begin))
        yours = np.flatnonzero(second)
        gap = np.full(len(begin), 50.0)
        if len(yours) and hit.any():
            h = np.flatnonzero(hit)
            after = np.minimum(np.searchsorted(yours, h), len(yours) - 1)
            for pick in (after, np.maximum(after - 1, 0)):
                same = at[yours[pick]] == at[h]
                gap[h[same]] = np.minimum(gap[h[same]], np.abs(place[h[same]] - yours[pick[same]]))
        caps = (count(upper, (begin, end)) == end - begin) & (end - begin > 1)
        columns = (np.ones(len(begin)), hit, weight, seed, second, gap <= 5, count(upper, (begin, end)), count(alpha, (begin, end)), caps)
        for i, c in enumerate(columns):
            sums[:, i] += np.bincount(at, c, minlength=n)
        signs = (tokens[1] - tokens[0]) - count(alpha, tokens) - count(digit, tokens)
        bang = count(total(raw == ord("!")), tokens)
        for i, c in ((9, signs), (10, bang), (11, odd.astype(float))):
            sums[:, i] += np.bincount(t_at, c, minlength=n)
        sums[:, 3] += np.bincount(t_at[odd], leet.astype(float), minlength=n)
        np.maximum.at(top, at, weight)
        np.minimum.at(nearest, at[hit], gap[hit])
    words, letters = np.maximum(sums[:, 0], 1), np.maximum(sums[:, 7], 1)
    size = np.maximum(np.diff(offsets), 1)
    return np.column_stack([
        np.log1p(sums[:, 1]), sums[:, 1] / words, np.log1p(sums[:, 2]), sums[:, 2] / words, top, np.log1p(sums[:, 3]), sums[:, 3] / words,
        sums[:, 4] / words, np.log1p(sums[:, 5]), nearest, sums[:, 6] / letters, sums[:, 8] / words, sums[:, 9] / size, sums[:, 10] / size, sums[:, 11] / words, np.log1p(sums[:, 0]),
    ])


def learn_lexicon(texts: DataFrame, entries_kept: int, least: int, text_col: str) -> Lexicon:
    """The words and beginnings that stand in more toxic texts than chance, by G2, at most `entries_kept` of them."""

    def run(batches):
        for batch in slices(batches, text_col):
            data, offsets = utf8(batch.column(text_col))
            toxic = np.asarray(batch.column("toxic"), bool)
            found = []
            for a, b in pieces(data, offsets):
                low = LOWER[data[a:b]]
                inner = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
                begin, end = spans(low, inner, _WORDS)
                at = (np.searchsorted(offsets, begin + a, "right") - 1).astype(np.uint64)
                for h in entries(low, begin, end):
                    found.append(np.stack([h, at], axis=1)[h > 0])
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)
            keys, place = np.unique(pairs[:, 0], return_inverse=True)
            bad = np.bincount(place, toxic[pairs[:, 1].astype(np.int64)], minlength=len(keys)).astype(np.int64)
            both = np.bincount(place, minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bad), pa.array(both - bad)], ["entry", "bad", "good"])

    n_bad, n_good = texts.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    counted = texts.select(text_col, "toxic").transform(in_arrow, run, "entry long, bad long, good long")
    counted = counted.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= least)
    odds = F.log((F.col("bad") + 0.5) / F.lit(n_bad + 1)) - F.log((F.col("good") + 0.5) / F.lit(n_good + 1))
    best = counted.withColumn("odds", odds).where(F.col("odds") > 1.5).orderBy(F.desc(F.col("bad") * F.col("odds")), "entry").limit(entries_kept).toPandas()
    return Lexicon.of(best["entry"].to_numpy(np.int64).view(np.uint64), best["odds"].to_numpy(np.float64))


def featurise(docs: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str) -> DataFrame:
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + "x array<double>"

    def run(batches):
        for batch in slices(batches, text_col):
            x = features(batch.column(text_col), lexicon)
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], x], [*keep, "x"])

    return docs.select(*dict.fromkeys([*keep, text_col])).transform(in_arrow, run, schema)


def score(
    docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, trees: int = 20, depth: int = 4, entries_kept: int = 2000, least: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """(id, held_out boolean, score double, predicted int) of every document.

    Where the rows to train on (by hash of the id) or those to calibrate on lack one of the labels, nothing can be fitted: every document
    then gets the share of label 1 among the known rows as its score, 0 without any.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg((F.max(label_col) > 0).alias("toxic"))
    n = max(1, known.count())
    known = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(n)) < train_rows).withColumn("part", F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(20)))
    texts = docs.select(id_col, text_col).join(F.broadcast(known), id_col)  # at most about train_rows rows
    texts = durable(texts.select(text_col, "toxic", "part").repartition(8))
    lexicon = learn_lexicon(texts.where(F.col("part") < 9), entries_kept, least, text_col)
    train = durable(featurise(texts.where(F.col("part") >= 9), lexicon, ["toxic", "part"], text_col).select(array_to_vector("x").alias("x"), F.col("toxic").cast("double").alias("label"), "part").coalesce(2))
    kinds = {(r["label"], r["late"]) for r in train.select("label", (F.col("part") >= 16).alias("late")).distinct().collect()}
    out = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), text_col)
    if len(kinds) < 4:
        share = texts.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
        return out.select(id_col, "held_out", F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    forest = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(train.where(F.col("part") < 16))
    probability = vector_to_array("probability")[1].alias("p")
    calibration = forest.transform(train.where(F.col("part") >= 16)).select(probability, "label")
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(calibration)
    scored = forest.transform(featurise(out, lexicon, [id_col, "held_out"], text_col).select(id_col, "held_out", array_to_vector("x").alias("x")))
    scored = isotonic.transform(scored.select(id_col, "held_out", probability))
    bounded = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select(id_col, "held_out", bounded.alias("score"), (bounded >= 0.5).cast("int").alias("predicted"))
