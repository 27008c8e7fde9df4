"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

The kernel counts common gapped subsequences of three characters inside a word, each
weighted by ``DECAY ** span`` (span at most ``SPAN``), so an insult with characters
inserted, replaced by marks or set apart keeps much of its likeness.  Words are taken
twice: as runs of letters and digits (runs of single characters are joined: "i d i o t"),
and as white-space words with marks left out ("id-iot").  A text's value is the largest
machine value of its words.

Learning uses only labelled rows where ``learn`` holds, at most about ``per_class``
texts of each label (smallest id hash; the bound is this parameter):
* witnesses: words that occur in toxic and hardly in clean texts, chosen greedily until
  the toxic texts are covered (a label marks a text, not a word; insults may be whole
  families of words with one stem, which the kernel carries over to unseen members);
* landmarks: the witnesses and frequent clean words; features K(x, L) K(L, L)^-1/2;
* a linear SVM on words: witnesses, also with one character inserted, against clean
  words, with the clean words that score highest added in a second round;
* the value is mapped to 0..1 by a logistic curve fitted on the sampled texts, moved so that
  it is THRESHOLD where they are told apart best.

The machine is linear in the subsequence features, so for scoring it is folded into one
table over character triples and whole texts are scored by table look-ups.

Defined cases: null and empty texts score as texts without any word; no toxic label to
learn from gives score 0 for every text; a document with several labels is toxic if one
says so; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.llm.langid import linear_svm
from tabflow.llm.text import slices, utf8
from tabflow.session import materialize

DECAY, SPAN = 0.6, 6
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
#: Symbols 0-25 letters, 26-35 digits, 36-67 accented Latin letters, 68-71 all others.
SYMBOLS = 72
FLOOR = -1.0                            # word values below this count as this
THRESHOLD = 0.7
_SYM = np.full(256, 255, np.uint8)
for _c in range(26):
    _SYM[65 + _c] = _SYM[97 + _c] = _c
for _c in range(10):
    _SYM[48 + _c] = 26 + _c
_SYM[192:] = 36                         # first byte of a character outside ASCII (see _symbols_of)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LIGHT = np.array([sum(max(0, n - b) * DECAY ** (2 * (b + 1)) for _, b in OFFSETS) for n in range(4096)])


def _symbols_of(buf: np.ndarray) -> np.ndarray:
    """Symbol of every byte (255: none)."""
    sym = _SYM[buf]
    wide = np.flatnonzero(sym == 36)
    if len(wide):
        tail = buf[np.minimum(wide + 1, len(buf) - 1)] & 63
        sym[wide] = np.where(buf[wide] == 0xC3, 36 + (tail & 31), 68 + (buf[wide] + tail) % 4)
    return sym


def symbols(buf: np.ndarray, offs: np.ndarray):
    """Symbols of the text with marks and spaces left out, each one's place, and two word numbers per symbol:
    runs of symbols (single ones joined) and white-space words."""
    sym = _symbols_of(buf)
    keep = sym != 255
    inner = (buf >= 128) & (buf < 192)                   # later bytes of a character: neither symbol nor mark
    solid = keep | inner
    at = np.flatnonzero(keep)
    edge = np.zeros(len(buf) + 1, np.int32)
    edge[offs] = 1
    row = np.cumsum(edge[:-1])                           # changes at every row start
    gap = np.cumsum(~solid)
    space = np.cumsum(_SPACE[buf])
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    g, sp, rw = gap[at], space[at], row[at]
    new_row = np.ones(len(at), bool)
    new_row[1:] = rw[1:] != rw[:-1]
    cut = new_row.copy()
    cut[1:] |= g[1:] != g[:-1]
    run = np.cumsum(cut) - 1
    size = np.bincount(run)
    head = np.flatnonzero(cut)
    single = size[run[head]] == 1
    apart = np.zeros(len(head), np.int64)
    apart[1:] = g[head[1:]] - g[head[1:] - 1]
    join = np.zeros(len(head), bool)
    join[1:] = single[1:] & single[:-1] & ~new_row[head[1:]] & (apart[1:] <= 2)
    run = (np.cumsum(~join) - 1)[run]
    white = new_row.copy()
    white[1:] |= sp[1:] != sp[:-1]
    return sym[at].astype(np.int64), at, run, np.cumsum(white) - 1


def _grams(sym: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(place, triple, weight) of the gapped triples of all words, one offset pair at a time."""
    for a, b in OFFSETS:
        if len(sym) <= b:
            continue
        n = len(sym) - b
        ok = np.flatnonzero(word[:n] == word[b:])
        yield ok, (sym[ok] * SYMBOLS + sym[ok + a]) * SYMBOLS + sym[ok + b], DECAY ** (b + 1)


def profile(word: str) -> dict[int, float]:
    """Gapped-triple features of one word (marks and spaces left out)."""
    raw = np.frombuffer(word.encode(), np.uint8)
    sym = _symbols_of(raw)
    sym = sym[sym != 255].astype(np.int64)
    out: dict[int, float] = {}
    for _, t, w in _grams(sym, np.zeros(len(sym), np.int64)):
        for k in t.tolist():
            out[k] = out.get(k, 0.0) + w
    return out


def kernel(words: list[str], marks: list[dict[int, float]]) -> np.ndarray:
    """Normalised kernel of every word with every landmark profile."""
    place = {k: i for i, k in enumerate(sorted({k for m in marks for k in m}))}
    table = np.zeros((len(place) + 1, len(marks)))
    for j, m in enumerate(marks):
        for k, v in m.items():
            table[place[k], j] = v
        table[:, j] /= np.linalg.norm(table[:, j]) or 1.0
    out = np.zeros((len(words), len(marks)))
    for i, w in enumerate(words):
        p = profile(w)
        if p:
            v = np.fromiter(p.values(), float, len(p))
            out[i] = v @ table[[place.get(k, len(place)) for k in p]] / np.linalg.norm(v)
    return out


@dataclass
class Model:
    table: np.ndarray | None = None        # machine weight of each triple
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0

    def word_values(self, sym, word, n_words):
        """(numerator, length) of each word."""
        value = np.zeros(len(sym), np.float32)
        for place, triple, w in _grams(sym, word):
            value[place] += w * self.table[triple]
        return np.bincount(word, value, n_words), np.bincount(word, minlength=n_words)

    def text_values(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Largest machine value of each row's words, ``FLOOR`` at least."""
        n = len(offs) - 1
        best = np.full(n, FLOOR - self.bias)
        sym, at, *kinds = symbols(buf, offs)
        if len(sym):
            for word in kinds:
                count = int(word[-1]) + 1
                num, size = self.word_values(sym, word, count)
                first = np.searchsorted(word, np.arange(count))
                bound = num / np.sqrt(np.maximum(_LIGHT[np.minimum(size, len(_LIGHT) - 1)], 1e-12))
                row = np.searchsorted(offs, at[first], side="right") - 1
                # the norm is at least the bound's: only words that could matter get their exact norm
                for k in np.flatnonzero((num > 0) & (bound + self.bias > FLOOR)).tolist():
                    own = sym[first[k]:first[k] + size[k]]
                    exact = num[k] / _norm(own)
                    if exact > best[row[k]]:
                        best[row[k]] = exact
        return best + self.bias

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * values + self.shift, -30, 30)))


def _norm(sym: np.ndarray) -> float:
    if len(sym) <= 64:
        out: dict[int, float] = {}
        s = sym.tolist()
        n = len(s)
        for a, b in OFFSETS:
            w = DECAY ** (b + 1)
            for i in range(n - b):
                k = (s[i] * SYMBOLS + s[i + a]) * SYMBOLS + s[i + b]
                out[k] = out.get(k, 0.0) + w
        return float(np.sqrt(sum(v * v for v in out.values()))) or 1.0
    total = np.zeros(SYMBOLS ** 3)
    for _, t, w in _grams(sym, np.zeros(len(sym), np.int64)):
        total += np.bincount(t, minlength=len(total)) * w
    return float(np.sqrt((total ** 2).sum())) or 1.0


def _labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int, id_col: str,
                     text_col: str, label_col: str) -> DataFrame:
    """Stored rows (text, toxic): about ``per_class`` labelled texts of each label, by id hash."""
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn)
             .groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) == 1).alias("toxic")))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    u = F.xxhash64(F.lit("toxicity"), F.col("_id")).cast("double") / 2.0 ** 64 + 0.5
    share = F.when(F.col("toxic"), min(1.0, per_class / max(n.get(True, 0), 1))) \
        .otherwise(min(1.0, per_class / max(n.get(False, 0), 1)))
    ids = known.filter(u <= share)
    # at most about 2 * per_class ids: a bound by parameter
    return materialize(docs.join(F.broadcast(ids), F.col(id_col) == F.col("_id"))
                       .select(F.col(text_col).alias("text"), "toxic").dropDuplicates(["text"])
                       .filter(F.col("text").isNotNull()))


def _word_rows(sample: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\s]", "")
    return sample.select("toxic", F.xxhash64("text").alias("t"),
                         F.explode(F.array_distinct(F.split(text, r"\s+"))).alias("word")) \
        .filter(F.length("word").between(3, 40))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 3000, clean_words: int = 3000,
        landmarks: int = 160, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    sample = _labelled_sample(docs, labels, learn, per_class, id_col, text_col, label_col)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(True):
        return Model()
    n_toxic, n_clean = n[True], n.get(False, 0)
    words = _word_rows(sample)
    counts = materialize(words.groupBy("word").agg(F.sum(F.col("toxic").cast("int")).alias("bad"),
                                                   F.sum((~F.col("toxic")).cast("int")).alias("good")))
    # candidates: ten times as common in toxic texts; at most 1024 of them
    likely = (counts.filter("bad > 1")
              .filter((F.col("bad") / n_toxic) > 10 * (F.col("good") + 0.5) / max(n_clean, 1))
              .orderBy(F.desc("bad"), "word").limit(1024).select("word"))
    texts_of = {r["word"]: set(r["t"]) for r in
                words.filter("toxic").join(F.broadcast(likely), "word")
                .groupBy("word").agg(F.collect_set("t").alias("t")).collect()}
    witnesses = _cover(texts_of, least=max(2, 0.002 * n_toxic))
    if not witnesses:
        return Model()
    return _fit_words(sample, counts, witnesses, clean_words, landmarks)


def _cover(texts_of: dict[str, set], least: float) -> list[str]:
    """Words that greedily cover the texts, and those about as common as the median of them."""
    uncovered, out = set().union(*texts_of.values()), []
    while uncovered and len(out) < len(texts_of):
        word = max(sorted(set(texts_of) - set(out)), key=lambda w: len(texts_of[w] & uncovered))
        if len(texts_of[word] & uncovered) < least:
            break
        out.append(word)
        uncovered -= texts_of[word]
    if out:
        common = np.median([len(texts_of[w]) for w in out])
        out += [w for w in sorted(texts_of) if w not in out and len(texts_of[w]) >= 0.5 * common]
    return sorted(out, key=lambda w: (-len(texts_of[w]), w))


def _variants(word: str, rng) -> list[str]:
    """The word, and the word with one character put in at each inner place."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    return [word] + [word[:i] + letters[rng.integers(36)] + word[i:] for i in range(1, len(word))]


def _fit_words(sample: DataFrame, counts: DataFrame, witnesses: list[str], clean_words: int,
               landmarks: int) -> Model:
    rng = np.random.default_rng(5)
    clean = counts.filter("good > 0 and bad <= good")
    common = [r["word"] for r in clean.orderBy(F.desc("good"), "word").limit(landmarks // 4).collect()]
    drawn = [r["word"] for r in clean.orderBy(F.xxhash64("word"), "word").limit(clean_words).select("word").collect()]
    chosen = [w for w in witnesses[:landmarks - len(common)] + common if profile(w)]
    marks = [profile(w) for w in chosen]
    gram = kernel(chosen, marks)
    value, vector = np.linalg.eigh(gram + 1e-6 * np.eye(len(marks)))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    good = [v for w in witnesses for v in _variants(w, rng)]
    bad = sorted(set(common + drawn) - set(witnesses))
    spark = sample.sparkSession
    model = Model()
    for _ in range(3):
        x = (kernel(good + bad, marks) @ root).astype(np.float32)
        times = max(len(bad) // max(len(good), 1), 1)
        y = np.array([1.0] * len(good) + [-1.0] * len(bad))
        x = np.vstack([x] + [x[:len(good)]] * (min(times, 20) - 1))
        y = np.append(y, np.ones(len(x) - len(y)))
        w = linear_svm(x, y, c=100.0, epochs=40)
        alpha = root @ w[:-1]
        table = np.zeros(SYMBOLS ** 3, np.float32)
        for a, m in zip(alpha, marks, strict=True):
            size = np.sqrt(sum(v * v for v in m.values()))
            for k, v in m.items():
                table[k] += a * v / size
        model = Model(table, float(w[-1]))
        sent = spark.sparkContext.broadcast(model)
        hard = (_values(clean.select(F.col("word").alias("text"), F.lit(False).alias("toxic")), sent)
                .orderBy(F.desc("value"), "text").limit(500).collect())
        bad = sorted(set(bad) | {r["text"] for r in hard if r["value"] > FLOOR} - set(witnesses))
    sent = spark.sparkContext.broadcast(model)
    found = _values(sample.select("text", "toxic"), sent).select("value", "toxic").collect()
    v, t = np.array([r["value"] for r in found]), np.array([r["toxic"] for r in found], float)
    model.slope, _ = _logistic(v, t)
    # the score is THRESHOLD where the sampled texts are told apart best
    model.shift = np.log(THRESHOLD / (1 - THRESHOLD)) - model.slope * _cut(v, t)
    return model


def _cut(v: np.ndarray, t: np.ndarray) -> float:
    """Value with the fewest errors on the sample; of several the middle of the widest gap."""
    order = np.argsort(v, kind="stable")
    v, t = v[order], t[order]
    ends = np.flatnonzero(np.diff(v) > 0)                       # cuts between different values
    if not len(ends):
        return float(v[0]) + 1.0 if not t.any() else float(v[0])
    errors = np.cumsum(t)[ends] + (1 - t).sum() - np.cumsum(1 - t)[ends]
    best = ends[errors == errors.min()]
    at = best[np.argmax(v[best + 1] - v[best])]
    return float((v[at] + v[at + 1]) / 2)


def _logistic(v: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve (Newton steps, smoothed targets, a little shrinkage)."""
    n1, n0 = t.sum(), len(t) - t.sum()
    t = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.stack([v, np.ones_like(v)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - t) + 1e-4 * b
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        b = b - step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
    return float(max(b[0], 1e-3)), float(b[1])


def _values(rows: DataFrame, sent) -> DataFrame:
    """(text, toxic, value) of rows (text, toxic)."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(_all_values(sent.value, batch.column(0)))],
                                  names=["text", "toxic", "value"])
    return rows.mapInArrow(stream, "text string, toxic boolean, value double")


def _all_values(model: Model, column) -> np.ndarray:
    buf, offs = utf8(column)
    out = [np.zeros(0)]
    for i, j in slices(offs):
        out.append(model.text_values(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]))
    return np.concatenate(out)


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1) and predicted (1 if score >= threshold)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = sent.value
        if m.table is None:
            return pd.Series(np.zeros(len(texts)))
        return pd.Series(m.scores(_all_values(m, pa.array(texts, pa.large_string(), from_pandas=True))))

    return (rows.withColumn("score", score("text"))
            .select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
