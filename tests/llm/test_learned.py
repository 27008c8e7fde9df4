"""Learned operators: exact parts against brute force, models by held-out quality."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.llm import gru_lm, langid, toxicity
from tabflow.llm.common import crc_mod, table

SF, SF_SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = gru_lm.start_weights(np.arange(70, 0, -1), np.full(gru_lm.FORMS, 5.0), 9.0)
    w = {k: v.astype(np.float64) for k, v in w.items()}
    lay = gru_lm.Layout(w)
    target = rng.integers(0, lay.end + 1 + gru_lm.FORMS, (7, 3))
    target[target >= 70] = lay.end + 1
    target[2, 1] = lay.end
    source = np.vstack([np.full((1, 3), lay.end), target[:-1]])
    old = gru_lm.F32
    gru_lm.F32 = np.float64

    def loss():
        h, out = np.zeros((3, gru_lm.HIDDEN)), 0.0
        for t in range(7):
            fresh = (source[t] == lay.end)[:, None]
            x = w["emb"][source[t]] @ w["wx"] + w["b"]
            hp = np.where(fresh, 0, h)
            zr = gru_lm._sigmoid(x[:, :2 * gru_lm.HIDDEN] + hp @ w["uzr"])
            z, r = zr[:, :gru_lm.HIDDEN], zr[:, gru_lm.HIDDEN:]
            c = np.tanh(x[:, 2 * gru_lm.HIDDEN:] + (r * hp) @ w["uh"])
            h = np.where(fresh, 0, hp + z * (c - hp))
            out -= gru_lm.output_log_prob(w, lay, h, target[t]).sum()
        return out / target.size

    try:
        grad, _ = gru_lm._window(w, lay, source, target, np.zeros((3, gru_lm.HIDDEN)))
        for name in w:
            flat = np.argsort(-np.abs(grad[name]).ravel())[:3]
            for i in flat:
                at = np.unravel_index(i, w[name].shape)
                keep, eps = w[name][at], 1e-5
                w[name][at] = keep + eps
                up = loss()
                w[name][at] = keep - eps
                down = loss()
                w[name][at] = keep
                assert np.isclose(grad[name][at], (up - down) / (2 * eps), rtol=1e-3, atol=1e-7), name
    finally:
        gru_lm.F32 = old


def test_probabilities_add_up_and_state_is_carried():
    w = gru_lm.start_weights(np.arange(70, 0, -1), np.full(gru_lm.FORMS, 5.0), 9.0)
    lay = gru_lm.Layout(w)
    h = np.random.default_rng(1).standard_normal((1, gru_lm.HIDDEN)).astype(np.float32)
    every = np.concatenate([np.arange(lay.end + 1 + gru_lm.FORMS)])
    lp = gru_lm.output_log_prob(w, lay, np.repeat(h, len(every), 0), every)
    assert np.isclose(np.exp(lp).sum(), 1, atol=1e-4)
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(0, 70, n), lay.end) for n in (200, 0, 3, 90)]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    both = gru_lm.score_documents(w, np.concatenate(docs).astype(np.int32), first, np.zeros(first[-1]))
    for d, got in zip(docs, both):
        alone = gru_lm.score_documents(w, d.astype(np.int32), np.array([0, len(d)]), np.zeros(len(d)))
        assert np.isclose(alone[0], got, rtol=1e-5)


def plain_training(w, docs, rate, seed):
    """Window after window, each weight by the formula of Adam."""
    w, lay = {k: v.copy() for k, v in w.items()}, gru_lm.Layout(w)
    tokens = np.concatenate([docs[i] for i in np.random.default_rng(seed).permutation(len(docs))])
    lanes = min(gru_lm.LANES, max(len(tokens) // gru_lm.STEPS, 1))
    per = -(-len(tokens) // lanes)
    target = np.resize(tokens, per * lanes).reshape(lanes, per).T
    source = np.vstack([np.full((1, lanes), lay.end), target[:-1]])
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    h = np.zeros((lanes, gru_lm.HIDDEN), np.float32)
    for step, t0 in enumerate(range(0, per, gru_lm.STEPS), 1):
        grad, h = gru_lm._window(w, lay, source[t0:t0 + gru_lm.STEPS], target[t0:t0 + gru_lm.STEPS], h)
        clip = min(1.0, 1.0 / np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grad.values())))
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * clip * g
            v[k] = 0.99 * v[k] + 0.01 * (clip * g) ** 2
            w[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)
    return w


def test_trainers_side_by_side_learn_as_each_alone_with_few_calls():
    """Trainers of several lengths (one with fewer lanes) get the weights of a plain training; ten share their calls."""
    import sys
    rng = np.random.default_rng(4)
    w = gru_lm.start_weights(np.arange(170, 0, -1), np.full(gru_lm.FORMS, 5.0), 9.0)
    end = gru_lm.Layout(w).end
    common = np.minimum(rng.geometric(0.05, (10, 40, 90)), 170) - 1
    groups = [[np.append(d, end).astype(np.int32) for d in docs] for docs in common]
    groups[1], groups[2] = groups[1][:30], groups[2][:3]
    for docs, got in zip(groups, gru_lm.train_many(w, groups, 0.01, seed=1)):
        want = plain_training(w, docs, 0.01, 1)
        assert all(np.allclose(got[k], want[k], rtol=1e-3, atol=2e-4) for k in w)
    calls = []
    for some in (groups[3:4], groups[3:] + groups[3:6]):
        calls.append(0)

        def count(frame, event, arg):
            calls[-1] += event in ("call", "c_call")

        sys.setprofile(count)
        try:
            gru_lm.train_many(w, some, 0.01)
        finally:
            sys.setprofile(None)
    assert calls[1] < 5 * calls[0]


def test_forms_and_ids_of_words_match_plain_ones():
    import pyarrow as pa

    from tabflow.llm.text import word_slices
    rng = np.random.default_rng(6)
    known = np.unique(np.concatenate([rng.integers(0, 2 ** 63, 300), rng.integers(0, 50, 40) + (5 << 48)])).astype(np.uint64)
    top = [{"hash": int(h.astype(np.int64)), "n": 9, "form": 1} for h in rng.permutation(known)]
    vocab = gru_lm.Vocabulary(top, [{"form": 1, "n": 9 * len(top), "v": len(top)}])
    place = {h["hash"]: i for i, h in enumerate(top)}
    asked = rng.permutation(np.concatenate([known, rng.integers(0, 2 ** 63, 500).astype(np.uint64), known + np.uint64(1),
                                            [gru_lm.END_HASH]]))
    form = rng.integers(0, gru_lm.FORMS, len(asked)).astype(np.uint8)
    want = [vocab.end if h == gru_lm.END_HASH else place.get(int(h.astype(np.int64)), vocab.end + 1 + int(f))
            for h, f in zip(asked, form)]
    assert vocab.ids(asked, form).tolist() == want
    text = "plain full. other! 9 x-1 Ünd über. naïve, 日本 :"
    (_, _, words), = word_slices(pa.chunked_array([pa.array([text, None, "z."])]), lower=True)
    assert gru_lm._forms(words).tolist() == [0, 1, 2, 0, 0, 3, 4, 5, 3, 2, 1]
    (_, _, words), = word_slices(pa.chunked_array([pa.array(["one two. ;", ""])]), lower=True)
    assert gru_lm._forms(words).tolist() == [0, 1, 2]


def brute_base(rows, learn):
    import re
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up)) + [None] for _, t in rows]
    c = {}
    for w, ok in zip(tokens, learn):
        for x in w if ok else []:
            c[x] = c.get(x, 0) + 1
    n, v = sum(c.values()), len(c)
    return [(len(w), sum(x in c for x in w), n, sum(np.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w))
            for w in tokens]


def test_counts_and_base_scores_match_brute_force(make, odd_rows):
    rng = random.Random(3)
    rows = odd_rows + [(100 + i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))))
                       for i in range(80)]
    learn = [i is not None and i % 3 != 0 for i, _ in rows]
    out = gru_lm.score_table(make(rows), (F.col("doc_id") % 3 != 0), shortlist=16, train_share=0.5, rounds=1).collect()
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out)
    want = sorted((str(i), *b[:3], round(b[3], 5)) for (i, _), b in zip(rows, brute_base(rows, learn)))
    assert got == want
    assert all(np.isfinite(r.score) and r.score <= 0 for r in out)
    assert gru_lm.score_table(make([]), F.lit(True)).count() == 0
    nothing = gru_lm.score_table(make(rows[:6]), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in nothing)


def test_rows_sent_for_counts_grow_with_the_chunks_not_their_square(spark, monkeypatch):
    """Four times the chunks send at most four times the rows: one for each distinct word of a chunk."""
    docs = table(spark, SF, "documents")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    sent = {}
    for chunks in (4, 16):
        monkeypatch.setattr(gru_lm, "CHUNK_BYTES", size // chunks + 1)
        words = gru_lm.count_words(gru_lm._chunked(docs, F.lit(True), "doc_id", "text"))
        sent[chunks] = words.count()
        got = words.agg(F.countDistinct("chunk"), F.countDistinct("hash"), F.count_if("head")).first()
        assert got[0] == chunks and got[1] == got[2]
    assert sent[4] < sent[16] <= 4 * sent[4]


def test_model_beats_the_unigram_base_on_held_out_texts(spark):
    out = gru_lm.score_table(table(spark, SF, "documents"), crc_mod("doc_id", 10) != 0, train_share=0.3)
    held = out.withColumn("held", crc_mod("doc_id", 10) == 0).filter("held").agg(
        F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > held.b


def held_out_sums(out):
    return out.filter(crc_mod("doc_id", 10) == 0).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()


def test_registered_model_beats_the_unigram_base_on_held_out_texts(spark):
    from tabflow.llm import catalog
    held = held_out_sums(catalog.QUERIES["op2_lm_score"](spark, SF))
    assert held.s > held.b


def test_small_tables_are_learned_too(make):
    rows = [(i, " ".join("abcdefgh"[(i + k) % 8] for k in range(60))) for i in range(40)]
    learn = crc_mod("doc_id", 10) != 0
    untrained = held_out_sums(gru_lm.score_table(make(rows), learn, train_share=0.0))
    assert held_out_sums(gru_lm.score_table(make(rows), learn)).s > untrained.s


def test_language_id_on_held_out_rows(spark, make, odd_rows):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2, per_language=200)
    held = langid.identify(docs.filter(crc_mod("doc_id", 4) == 2), model)
    right = held.filter(F.col("lang").isNotNull()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    odd = langid.identify(make(odd_rows), model)
    assert odd.count() == len(odd_rows)
    rows = {r.doc_id: r for r in odd.collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].lang_score == 0 for i in (1, 2, 3, 13))
    assert all(0 <= r.lang_score <= 1 for r in rows.values()) and rows[4].lang_pred in {"en", "de", "es", "fr"}
    kept = langid.keep_identified(make(odd_rows), model)
    assert kept.columns == make([]).columns and kept.count() == len(odd_rows) - 4
    none = langid.fit(make([]), F.lit(True))
    assert {r.lang_pred for r in langid.identify(make(odd_rows), none).collect()} == {"und"}


def test_one_language_only(make):
    rows = [(i, f"hello number {i} of many", "en") for i in range(10)]
    model = langid.fit(make(rows), F.lit(True))
    assert {r.lang_pred for r in langid.identify(make(rows), model).collect()} == {"en"}


def test_copies_do_not_thin_out_the_learned_texts(make, monkeypatch):
    """A text copied into most rows of a language leaves the bound of distinct texts as it is."""
    rows = [(i, f"hello number {i} of many", "en") for i in range(30)] + [(100 + i, "the copied text", "en")
                                                                          for i in range(3000)]
    rows += [(5000 + i, f"una frase numero {i}", "es") for i in range(30)]
    learned, fitted = [], langid.linear_svm
    monkeypatch.setattr(langid, "linear_svm", lambda x, y, **k: learned.append((y > 0).sum()) or
                        learned.append((y < 0).sum()) or fitted(x, y, **k))
    langid.fit(make(rows), F.lit(True), per_language=20)
    assert learned == [40, 40]                             # whole and short piece of 20 texts


INSULTS = ["idiot", "moron", "trash", "scum"]


@pytest.fixture(scope="module")
def toxic_model(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice(["ba", "de", "fi", "lo", "mu", "ran", "sel", "tor"]) for _ in range(rng.randint(1, 4)))
             for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 40))]
        if i % 3 == 0:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(INSULTS))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 2 == 0,
                        clean_words=300), docs, dict(labels)


def test_toxic_texts_are_found(toxic_model):
    model, docs, labels = toxic_model
    out = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i in labels if i % 2]
    assert np.mean([out[i].predicted == labels[i] for i in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in out.values())


def test_gapped_insults_score_above_clean_words(make, toxic_model):
    model = toxic_model[0]
    rows = [(1, "bade fi IDIOT. lomu"), (2, "you i d i o t"), (3, "such id-iot"), (4, "lo idxiot mu"), (5, "bade filo mutor"),
            (6, None), (7, ""), (8, "!!!"), (9, "x " * 20_000)]
    s = {r.doc_id: r.score for r in toxicity.score_documents(make(rows), model).collect()}
    assert min(s[1], s[2], s[3]) > 0.7 and s[4] > s[5]
    assert s[6] == s[7] == s[8] < 0.5
    assert toxicity.score_documents(make([]), model).count() == 0


def test_nothing_to_learn_from(make):
    docs = make([(1, "some text"), (2, None)])
    labels = docs.selectExpr("doc_id", "CAST(NULL AS INT) AS toxic")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert [r.score for r in toxicity.score_documents(docs, model).collect()] == [0.0, 0.0]


def test_kernel_is_the_gapped_subsequence_kernel():
    def brute(a, b):
        def feats(s):
            out = {}
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                        out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0) + toxicity.DECAY ** (k - i + 1)
            return out
        x, y = feats(a), feats(b)
        dot = lambda p, q: sum(v * q.get(t, 0) for t, v in p.items())
        return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))
    for a, b in (("idiot", "idxiot"), ("stupid", "stupidly"), ("trash", "thrash"), ("banana", "bananas")):
        assert np.isclose(toxicity.kernel([a], [toxicity.profile(b)])[0, 0], brute(a, b))


def test_table_scoring_equals_the_kernel(toxic_model):
    """The folded table gives the machine's value for single words."""
    import pyarrow as pa
    model = toxic_model[0]
    for w in ("idiot", "idiots", "torsel", "moron"):
        p = toxicity.profile(w)
        direct = sum(v * model.table[k] for k, v in p.items()) / np.sqrt(sum(v * v for v in p.values())) + model.bias
        assert np.isclose(toxicity._all_values(model, pa.array([w]))[0], max(direct, toxicity.FLOOR), atol=1e-5)


def test_small_tables_have_the_contract_columns(spark):
    from tabflow.llm import catalog
    out = catalog.QUERIES["op8_toxicity"](spark, SF_SMALL)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
