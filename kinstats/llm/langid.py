"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its own code point. A trigram is the product of its letters'
vectors, rotated by two, one and no places; a text or a language is the sum (bundle) of the vectors of its trigrams. A
text gets the language whose prototype has the largest cosine with it.

The bundle of a text is never laid out: its inner product with a prototype is the sum of its trigrams' products with it,
and its length is taken as that of independent trigram vectors, the root of the sum of squared counts times the
dimension (off by some hundredths; the order of the languages does not depend on it). Tasks get one vector a language
and remember the products of ``REMEMBERED`` trigrams.

Defined cases: a null text, and one without letters, is ``und`` with score 0; languages that are null are not learned;
with no language learned all is ``und``; of equal cosines the alphabetically first language wins; texts of any length
are read whole, and what else is in their batch never matters; an empty table gives an empty result; other columns are
ignored and repeated rows are judged alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

UNDECIDED = "und"
REMEMBERED = 400_000
POINT = 21  # bits of a code point


def letter_of(point: int) -> int:
    """Code point of the small letter, or 0 for what is no letter."""
    x = chr(point)
    return ord(x.lower()[0]) if x.isalpha() else 0


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams as three code points in one number (0 is a gap), the place among them of every trigram of the
    texts end to end, and the number of each text's trigrams.

    Runs of what is no letter are one gap, texts begin and end with one, and trigrams have a letter in the middle.
    """
    joined = "\0\0".join(" " if x is None else x for x in texts) + "\0\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), np.array([1 if x is None else len(x) for x in texts], np.int64) + 2)
    used, s = _distinct(points.astype(np.int64))
    letters, number = np.unique(np.array([0, *map(letter_of, used.tolist())], np.int64), return_inverse=True)
    s = number[1:][s]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (row[1:] != row[:-1])
    s, row = s[keep], row[keep]
    new = row[1:] != row[:-1]
    before, after = np.concatenate(([0], s[:-1])), np.concatenate((s[1:], [0]))
    before[1:][new] = 0
    after[:-1][new] = 0
    at = s > 0
    codes, place = _distinct(((before * len(letters) + s) * len(letters) + after)[at])
    a, b, c = codes // len(letters) ** 2, codes // len(letters) % len(letters), codes % len(letters)
    return (letters[a] << (2 * POINT)) | (letters[b] << POINT) | letters[c], place, np.bincount(row[at], minlength=len(texts))


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the place of each code; by counting where they are small."""
    if len(codes) and int(codes.max()) < 1 << 22:
        there = np.bincount(codes) > 0
        return np.flatnonzero(there), (np.cumsum(there) - 1)[codes]
    return np.unique(codes, return_inverse=True)


def trigram_vectors(dimension: int, seed: int, keys: np.ndarray) -> np.ndarray:
    """The vectors of the given trigrams, one a row."""
    three = np.stack([keys >> (2 * POINT), keys >> POINT, keys]) & ((1 << POINT) - 1)
    used, place = np.unique(three, return_inverse=True)
    letters = np.array([np.random.default_rng([seed, int(x)]).choice(np.array([-1, 1], np.int8), dimension) for x in used], np.int8).reshape(len(used), dimension)
    a, b, c = place.reshape(three.shape)
    return np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]


def learn(train: DataFrame, dimension: int = 2048, seed: int = 7) -> dict[str, np.ndarray]:
    """Language -> prototype, from ``text`` and ``lang`` of all rows of ``train``.

    Tasks count trigrams by language, Spark adds the counts up, tasks bundle them and Spark adds up the bundles; the
    driver gets one vector a language.
    """

    def count(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                langs = part.column(1).to_pylist()
                keys, place, n = trigrams(part.column(0).to_pylist())
                order = sorted(set(langs))
                which = np.repeat(np.searchsorted(order, langs), n)
                for k, lang in enumerate(order):
                    counts = np.bincount(place[which == k], minlength=len(keys))
                    some = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(keys[some]), pa.array(counts[some].astype(np.int64))], ["lang", "trigram", "n"])

    def bundle(batches):
        sums = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for at in range(0, len(langs), 1024):
                some = slice(at, at + 1024)
                vectors = trigram_vectors(dimension, seed, batch.column(1).to_numpy()[some]).astype(np.float64)
                counts = batch.column(2).to_numpy()[some].astype(np.float64)
                for lang in set(langs[some]):
                    sums[lang] = sums.get(lang, 0) + np.where(langs[some] == lang, counts, 0) @ vectors
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimension, pa.string()), pa.array(range(dimension), pa.int32()), pa.array(total)], ["lang", "k", "x"])

    rows = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(count, "lang string, trigram long, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for lang, k, x in counts.mapInArrow(bundle, "lang string, k int, x double").groupBy("lang", "k").agg(F.sum("x")).collect():  # languages x dimension
        out.setdefault(lang, np.zeros(dimension))[k] = x
    return out


def centred(prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, one a row, of length one; what all have in common tells nothing and is taken off."""
    names = sorted(prototypes)
    vectors = np.array([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-12) for x in names])
    if len(names) > 1:
        vectors = vectors - vectors.mean(0)
    return names, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12) if names else vectors


class Products:
    """Inner products of trigrams' vectors with prototypes, over both lengths; those of trigrams once met are remembered."""

    def __init__(self, vectors: np.ndarray, seed: int):
        self.vectors, self.seed, self.dimension = vectors.astype(np.float32), seed, vectors.shape[1]
        self.keys, self.values = np.zeros(0, np.int64), np.zeros((0, len(vectors)), np.float32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """A row for each of ``keys``, which are sorted and distinct."""
        new = np.setdiff1d(keys, self.keys, assume_unique=True)
        if len(new):
            if len(self.keys) > REMEMBERED:
                self.keys, self.values, new = self.keys[:0], self.values[:0], keys
            made = [trigram_vectors(self.dimension, self.seed, new[at : at + 4096]).astype(np.float32) @ self.vectors.T for at in range(0, len(new), 4096)]
            every = np.concatenate((self.keys, new))
            order = np.argsort(every)
            self.keys, self.values = every[order], np.concatenate((self.values, np.concatenate(made) / np.float32(np.sqrt(self.dimension))))[order]
        return self.values[np.searchsorted(self.keys, keys)]


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], seed: int = 7) -> DataFrame:
    """``keep`` columns of ``docs``, ``lang_pred`` and ``score``: the cosine, from 0 to 1."""
    names, vectors = centred(prototypes)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        products = Products(shared.value, seed) if names else None
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                langs, scores = [UNDECIDED] * len(texts), np.zeros(len(texts))
                if names:
                    keys, place, n = trigrams(texts)
                    order = np.argsort(keys)
                    weights = np.empty((len(keys), len(names)), np.float32)
                    weights[order] = products.of(keys[order])
                    stops = np.cumsum(n)
                    for i in np.flatnonzero(n):
                        used, counts = np.unique(place[stops[i] - n[i] : stops[i]], return_counts=True)
                        cosines = counts @ weights[used] / np.sqrt(np.square(counts, dtype=np.float64).sum())
                        best = int(np.argmax(cosines))
                        langs[i], scores[i] = names[best], min(1.0, max(0.0, float(cosines[best])))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores)], [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double")
