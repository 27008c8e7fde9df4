"""Language identification by hierarchical discrimination.

First the language family is predicted, then the language within it.  Both steps
are ensembles of one-versus-one linear support vector machines on relative
frequencies of hashed character 1- to 3-grams; votes decide, margins break ties.

Learning: per language at most ``per_language`` distinct texts (those with the
smallest text hash), a bound stated here and given as a parameter; each also
contributes a short piece of itself, so that short texts are met in training.
Their n-gram counts are made on the executors, the machines are fitted from that
bounded sample by dual coordinate descent.  Prediction runs over whole texts in
Arrow batches.

Defined cases: a text that is null or has no letter gets ``und`` with score 0;
with no labelled text at all every other text gets ``und``; a language outside the
family table is a family of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
#: Families of common languages.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sk": "slavic",
}
BITS = 12
ORDERS = (1, 2, 3)
CHARS = 1 << 17

_U = np.uint64
_ASCII = np.where([chr(c).isalpha() for c in range(128)], np.arange(128), 32).astype(np.uint32)


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bin of every n-gram and the text it belongs to (ascending)."""
    padded = [f" {t.lower()} " for t in texts]
    ends = np.cumsum([len(t) for t in padded])
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 128, _ASCII[np.minimum(points, 127)], points).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    for n in ORDERS:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h + points[k:len(h) + k]) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(29)
        ok = row[:len(h)] == row[n - 1:]
        ok &= ~((points[:len(h)] == 32) & (points[n - 1:] == 32))
        yield (h[ok] >> _U(64 - BITS)).astype(np.int64), row[:len(h)][ok]


def features(texts: list[str]) -> np.ndarray:
    """Relative n-gram frequencies, one row per text."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for bins, row in _grams(texts):
        np.add.at(out, (row, bins), 1)
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7,
               rows: np.ndarray | None = None) -> np.ndarray:
    """Weights (last one: bias) of an L2-loss linear SVM on some rows of x, by dual coordinate descent."""
    rows = np.arange(len(x)) if rows is None else rows
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(rows))
    norm = np.einsum("ij,ij->i", x, x)[rows] + 1 + 0.5 / c
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            xi = x[rows[i]]
            g = y[i] * (xi @ w + bias) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * xi
                bias += step
                alpha[i] = new
    return np.append(w, bias)


@dataclass
class Model:
    """``machines[m]`` separates classes a (positive) and b; its weights are column m of ``weights``."""

    families: dict[str, list[str]] = field(default_factory=dict)
    machines: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    steep: np.ndarray | None = None

    def margins(self, texts: list[str]) -> np.ndarray:
        """Margin of every machine for every text: a sum of weights over its n-grams, over their number."""
        out, count = np.zeros((len(texts), len(self.machines))), np.zeros(len(texts))
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j]) <= CHARS):
                n += len(texts[j])
                j += 1
            for bins, row in _grams(texts[i:j]):
                if not len(row):
                    continue
                first = np.flatnonzero(np.diff(row, prepend=-1))
                at = row[first] + i
                count[at] += np.diff(np.append(first, len(row)))
                for m in range(out.shape[1]):
                    out[at, m] += np.add.reduceat(self.weights[m][bins], first)
            i = j
        return out / np.maximum(count, 1)[:, None] + self.bias

    def _vote(self, classes: list[str], margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner among classes (index) and its mean probability against the others."""
        n = len(margin)
        if len(classes) == 1:
            return np.zeros(n, int), np.ones(n)
        votes, prob = np.zeros((n, len(classes))), np.zeros((n, len(classes)))
        for m, (a, b) in enumerate(self.machines):
            if a in classes and b in classes:
                p = 1 / (1 + np.exp(-np.clip(self.steep[m] * margin[:, m], -30, 30)))
                ia, ib = classes.index(a), classes.index(b)
                votes[:, ia] += p > 0.5
                votes[:, ib] += p <= 0.5
                prob[:, ia] += p
                prob[:, ib] += 1 - p
        best = np.argmax(votes + prob / (2 * len(classes)), axis=1)
        return best, prob[np.arange(n), best] / (len(classes) - 1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        margin = self.margins(texts)
        names = sorted(self.families)
        fam, score = self._vote([f"/{f}" for f in names], margin)
        lang = np.empty(len(texts), object)
        for i, f in enumerate(names):
            members = self.families[f]
            mine = np.flatnonzero(fam == i)
            if len(mine):
                best, p = self._vote(members, margin[mine])
                lang[mine] = [members[b] for b in best]
                score[mine] *= p
        return list(lang), score


def fit(docs: DataFrame, learn: Column, per_language: int = 800, families: dict[str, str] = FAMILIES,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the rows where ``learn`` holds, from at most ``per_language`` texts per language."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & has_letter(text_col)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    draw = F.xxhash64(F.lit("langid"), F.col("text"))
    # distinct texts: copies must not thin out the others
    known = {r["lang"]: r["n"] for r in rows.select("lang", draw.alias("h")).distinct()
             .groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not known:
        return Model()
    share = F.create_map(*[x for k, n in sorted(known.items()) for x in
                           (F.lit(k), F.lit(min(1.0, 3 * per_language / n)))])
    picked = (rows.withColumn("h", draw)
              .filter((F.col("h").cast("double") / 2.0 ** 64 + 0.5) <= F.element_at(share, F.col("lang")))
              .dropDuplicates(["lang", "h"]))

    def pieces(batches):
        for pdf in batches:
            made = []
            for lang, text, h in zip(pdf["lang"], pdf["text"], pdf["h"], strict=True):
                words = text.split()
                at = h % max(len(words) - 6, 1)
                both = features([text, " ".join(words[at:at + 6])])
                for x in both:
                    bins = np.flatnonzero(x)
                    made.append((lang, h, bins.astype(np.int32).tobytes() + x[bins].tobytes()))
            yield pd.DataFrame(made, columns=["lang", "h", "grams"])

    order = Window.partitionBy("lang").orderBy("h")
    sample = (picked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_language)
              .select("lang", "text", "h")
              .mapInPandas(pieces, "lang string, h long, grams binary").toPandas()
              .sort_values(["lang", "h", "grams"]))
    x = np.zeros((len(sample), 1 << BITS), np.float32)
    for i, raw in enumerate(sample["grams"]):
        half = len(raw) // 2
        x[i, np.frombuffer(raw[:half], np.int32)] = np.frombuffer(raw[half:], np.float32)
    lang = sample["lang"].to_numpy()
    del sample
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    x *= scale
    family = {k: families.get(k, k) for k in known}
    fam = np.array([f"/{family[k]}" for k in lang])
    members = {f: sorted(k for k in known if family[k] == f) for f in set(family.values())}
    model, w, steep = Model(families=members), [], []
    tasks = [(fam, pair) for pair in combinations(sorted({f"/{f}" for f in members}), 2)]
    tasks += [(lang, pair) for f in sorted(members) for pair in combinations(members[f], 2)]
    for label, (a, b) in tasks:
        rows_of = np.flatnonzero((label == a) | (label == b))
        y = np.where(label[rows_of] == a, 1.0, -1.0)
        if len(set(y)) < 2:
            y = np.append(y, -y[-1:])
            rows_of = np.append(rows_of, rows_of[-1:])
        wt = linear_svm(x, y, rows=rows_of)
        model.machines.append((a, b))
        w.append(np.append(wt[:-1] * scale, wt[-1]))
        spread = np.median(np.abs((x @ wt[:-1].astype(np.float32))[rows_of] + wt[-1]))
        steep.append(3.0 / max(spread, 1e-6))
    model.weights = np.array([v[:-1] for v in w], np.float32) if w else np.zeros((0, 1 << BITS), np.float32)
    model.bias, model.steep = np.array([v[-1] for v in w]), np.array(steep)
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``lang_score`` (one Arrow pass, no shuffle)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = sent.value
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        given = np.flatnonzero(texts.notna().to_numpy())
        if m.families and len(given):
            found, p = m.predict(texts.iloc[given].tolist())
            score[given] = p
            for i, k in zip(given, found, strict=True):
                lang[i] = k
        return pd.DataFrame({"lang_pred": lang, "score": score})

    found = predict(F.when(has_letter(text_col), F.col(text_col)))
    taken = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    return docs.withColumn("_lang", found).select(
        *taken, F.col("_lang.lang_pred").alias("lang_pred"), F.col("_lang.score").alias("lang_score"))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows whose text has a language (the others are rejected); columns as given.  Without any learned language
    nothing can be rejected for its language: every text with a letter stays."""
    if not model.families:
        return docs.filter(has_letter(text_col))
    base = docs.select(F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    kept = identify(base, model, text_col="text").filter(F.col("lang_pred") != UNKNOWN)
    return kept.select("row.*")
