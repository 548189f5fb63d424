"""Language identification by hierarchical discrimination.

A text's family is predicted first; then one-versus-one linear support vector machines tell the languages of that
family apart. Features are hashed byte n-grams of the lower-cased whole text, as unit vectors of root counts.
Families follow the usual genealogy (``FAMILIES``); a language not listed there is a family of its own, so
closely related languages meet in a second-stage machine and all others in the first.

The machines are fitted on a sample of at most ``per_language`` labelled texts of each language, taken by the hash of the
text; every other number comes from the whole text of each row.

A null text, or one without a letter, is ``und`` with score 0. With no labelled text at all, every text is ``und``.
Rows with a null id count as held out. Ties between languages go to the first in order. Repeated rows give equal predictions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, chunks

# Language codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "ur", "bn", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt", "am"),
    "uralic": ("fi", "et", "hu"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
SIZE = 1 << 13


def counts(text: str) -> np.ndarray:
    """Unit vector of the root counts of a text's 2- and 4-byte grams, hashed to SIZE places."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    two = data[:-1] | data[1:] << np.uint32(8)
    grams = [(two * np.uint32(2654435761)) >> np.uint32(19)]
    if len(data) > 3:
        grams.append(((two[:-2] | two[2:] << np.uint32(16)) * np.uint32(2246822519)) >> np.uint32(19))
    out = np.sqrt(np.bincount(np.concatenate(grams), minlength=SIZE))
    return out / max(1e-12, np.sqrt((out * out).sum()))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def support_vector_machine(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 40) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by dual coordinate descent; the last weight is the bias."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    diagonal = 1 / (2 * cost * share)
    norm = (x * x).sum(axis=1) + diagonal
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            slope = y[i] * (w @ x[i]) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Model:
    """First-stage machines between families and second-stage machines between the languages of one family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs)
        self.langs = sorted(set(langs))
        family = np.array([FAMILY_OF.get(n, n) for n in langs])
        self.families = sorted(set(family))
        self.members = {f: [n for n in self.langs if FAMILY_OF.get(n, n) == f] for f in self.families}
        self.first = self._pairs(x, family, self.families)
        self.second = {f: self._pairs(x, names, m) for f, m in self.members.items()}

    @staticmethod
    def _pairs(x: np.ndarray, names: np.ndarray, among: list[str]) -> tuple[list[tuple[int, int]], np.ndarray]:
        pairs = list(combinations(range(len(among)), 2))
        rows = []
        for a, b in pairs:
            use = (names == among[a]) | (names == among[b])
            rows.append(support_vector_machine(x[use], np.where(names[use] == among[a], 1.0, -1.0)))
        return pairs, np.array(rows, dtype=np.float64).reshape(len(pairs), SIZE + 1)

    @staticmethod
    def _vote(machines: tuple[list[tuple[int, int]], np.ndarray], n: int, v: np.ndarray) -> tuple[int, float]:
        """The name with most won pairs (then the largest sum of margins), and how sure its pairs are, 0 to 1."""
        pairs, w = machines
        if not pairs:
            return 0, 1.0
        margin = w[:, :-1] @ v + w[:, -1]
        won, total, least = np.zeros(n), np.zeros(n), np.full(n, np.inf)
        for (a, b), m in zip(pairs, margin, strict=True):
            won[a if m >= 0 else b] += 1
            for k, s in ((a, m), (b, -m)):
                total[k] += s
                least[k] = min(least[k], s)
        best = max(range(n), key=lambda k: (won[k], total[k], -k))
        return best, float(1 / (1 + np.exp(-4 * least[best])))

    def predict(self, text: str) -> tuple[str, float]:
        v = counts(text)
        f, sure = self._vote(self.first, len(self.families), v)
        members = self.members[self.families[f]]
        k, more = self._vote(self.second[self.families[f]], len(members), v)
        return members[k], min(sure, more)


def _vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            v = counts(text)
            at = np.flatnonzero(v).astype(np.int32)
            rows.append((lang, at.tobytes(), v[at].astype(np.float32).tobytes()))
        yield pd.DataFrame(rows, columns=["lang", "at", "value"])


def fit(labelled: DataFrame, per_language: int = 250) -> Model | None:
    """Fit on (id, text, lang) rows: a sample of at most ``per_language`` texts of each language, by hash of id and text."""
    labelled = labelled.filter("text is not null and lang is not null and text rlike '\\\\p{L}'")
    rows = bounded_sample(labelled, "lang", per_language, "id", "text").mapInPandas(_vectors, "lang string, at binary, value binary").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["value"])))
    x = np.zeros((len(rows), SIZE))
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], dtype=np.int32)] = np.frombuffer(r["value"], dtype=np.float32)
    return Model(x, [r["lang"] for r in rows]) if rows else None


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 250) -> DataFrame:
    """``docs`` with held_out, lang_pred and score added (existing columns of these names are replaced).

    Rows whose crc32 of the id is 2 modulo 4 are held out: nothing is learned from them.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))
    model = fit(docs.filter(~held).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), per_language)
    shared = spark.sparkContext.broadcast(model)

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = shared.value
        for series in texts:
            rows = [found.predict(t) if found and has_letter(t) else ("und", 0.0) for t in series]
            yield pd.DataFrame({"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows]})

    told = F.pandas_udf(score, "lang_pred string, score double")
    keep = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score", "_told")]
    out = docs.withColumn("_told", told(F.col(text_col)))
    return out.select(*keep, held.alias("held_out"), F.col("_told.lang_pred").alias("lang_pred"), F.col("_told.score").alias("score"))
