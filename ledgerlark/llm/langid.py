"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is bound from its letters: each letter's vector is
permuted (rolled) by its place in the n-gram and the vectors are multiplied. A text is the bundle (sum) of
the vectors of its n-grams, a language the bundle of its training texts. A text gets the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = 32


@lru_cache(1)
def letter_table() -> np.ndarray:
    """By code point, the lower-case letter's code point, or a blank for all that isn't a letter."""
    table = np.full(0x110000, SPACE, np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@lru_cache(100_000)
def letter_vector(code: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, code]).integers(0, 2, dims, np.int8) * 2 - 1


def text_grams(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams over letters and single blanks, as integers of 21 bits a letter, with their counts.

    n-grams of nothing but a blank and fewer than two letters are left out.
    """
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate(([SPACE], codes, [SPACE]))
    blank = codes == SPACE
    codes = codes[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(codes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.zeros(len(codes) - n + 1, np.int64)
    for k in range(n):
        keys = keys << 21 | codes[k : len(codes) - n + 1 + k]
    return np.unique(keys, return_counts=True)


def gram_matrix(keys: np.ndarray, n: int, dims: int, seed: int) -> np.ndarray:
    """One bound vector for each n-gram."""
    letters, out = np.unique(np.concatenate([keys >> (21 * k) & 0x1FFFFF for k in range(n)])), None
    own = np.stack([letter_vector(int(c), dims, seed) for c in letters]) if len(letters) else np.zeros((0, dims), np.int8)
    for k in range(n):
        part = np.roll(own, k, axis=1)[np.searchsorted(letters, keys >> (21 * k) & 0x1FFFFF)]
        out = part if out is None else out * part
    return out.astype(np.float32)


def bundles(texts: list[str], n: int, dims: int, seed: int) -> np.ndarray:
    """One bundle for each text; counts are damped by a square root, so no n-gram drowns the others."""
    grams = [text_grams(t, n) for t in texts]
    keys = np.unique(np.concatenate([g[0] for g in grams])) if grams else np.zeros(0, np.int64)
    out = np.zeros((len(texts), dims), np.float32)
    for at in range(0, len(keys), 4096):
        block = keys[at : at + 4096]
        counts = np.zeros((len(texts), len(block)), np.float32)
        for row, (own, times) in enumerate(grams):
            lo, hi = np.searchsorted(own, [block[0], block[-1] + 1])
            counts[row, np.searchsorted(block, own[lo:hi])] = np.sqrt(times[lo:hi])
        out += counts @ gram_matrix(block, n, dims, seed)
    return out


def _groups(texts: list[str], most_chars: int = 400_000, most: int = 64) -> Iterator[list[int]]:
    group, chars = [], 0
    for i, t in enumerate(texts):
        if group and (chars + len(t) > most_chars or len(group) >= most):
            yield group
            group, chars = [], 0
        group, chars = [*group, i], chars + len(t)
    if group:
        yield group


def train(labelled: DataFrame, n: int = 3, dims: int = 1024, seed: int = 7, most_per_lang: int = 2000) -> dict[str, np.ndarray]:
    """Prototypes by language from rows of text and lang; null langs and null texts teach nothing.

    The classifier is fitted on a bounded sample: texts of about `most_per_lang` rows of each language, chosen by
    a hash of the text, each text once however often it is repeated. Every label gets a profile. Partitions bundle
    their rows, and the sums, one number for each language and dimension, are all that reaches the driver: 8 kB a
    label. They are whole numbers of 1/256, so their order is free.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    frequent = rows.groupBy("lang").count().where(F.col("count") > most_per_lang).collect()  # languages of more texts than that
    limits = [(r["lang"], int(most_per_lang / r["count"] * (1 << 50))) for r in frequent]
    if limits:
        few = labelled.sparkSession.createDataFrame(limits, "lang string, limit__ long")
        few = F.broadcast(few) if len(limits) <= 100_000 else few  # a few bytes each; a shuffle of whole texts otherwise
        rows = rows.join(few, "lang", "left").where(F.coalesce(F.pmod(F.xxhash64("text"), F.lit(1 << 50)) < F.col("limit__"), F.lit(True))).select("text", "lang")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            texts, langs = frame["text"].tolist(), frame["lang"].tolist()
            for group in _groups(texts):
                made = bundles([texts[i] for i in group], n, dims, seed)
                norms = np.linalg.norm(made, axis=1, keepdims=True)
                made = np.rint(made / np.where(norms == 0, 1, norms) * 256 * np.sqrt(dims)).astype(np.int64)
                for i, vector in zip(group, made):
                    sums[langs[i]] = sums.get(langs[i], 0) + vector
        if sums:
            yield pd.DataFrame({"lang": list(sums), "sums": [v.tolist() for v in sums.values()]})

    part = rows.distinct().mapInPandas(run, "lang string, sums array<bigint>")
    summed = part.select("lang", F.posexplode("sums").alias("dim", "value")).groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in summed.collect():  # languages x dims numbers
        out.setdefault(r["lang"], np.zeros(dims))[r["dim"]] = r["value"]
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], n: int = 3, dims: int = 1024, seed: int = 7, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with lang_pred (a learned language, or `und`) and score (cosine, 0 to 1) of each text.

    `und` with score 0 goes to null texts, texts without any letter and, without prototypes, to all. Of equal
    cosines the first language by name wins. Rows stay one for one with all their columns; own columns of
    these two names, which `names` can change, are replaced; an empty table stays empty. Texts are read whole.
    """
    langs = sorted(prototypes)
    matrix = np.stack([prototypes[x] / (np.linalg.norm(prototypes[x]) or 1.0) for x in langs]).astype(np.float32) if langs else None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts = [t or "" for t in series]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            for group in _groups(texts) if langs else ():
                made = bundles([texts[i] for i in group], n, dims, seed)
                norms = np.linalg.norm(made, axis=1)
                cosines = made @ matrix.T / np.where(norms == 0, 1, norms)[:, None]
                for row, i in enumerate(group):
                    if any(c.isalpha() for c in texts[i]):
                        best = int(cosines[row].argmax())
                        names[i], scores[i] = langs[best], float(min(1.0, max(0.0, cosines[row, best])))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    guess, own = F.pandas_udf(run, "lang_pred string, score double"), "guess__"
    while own in docs.columns:
        own += "_"
    told = docs.withColumn(own, guess(F.col("text").cast("string")))
    kept = [F.col(c) for c in docs.columns if c not in names]
    return told.select(*kept, F.col(f"{own}.lang_pred").alias(names[0]), F.col(f"{own}.score").alias(names[1]))
