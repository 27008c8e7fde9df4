"""Hard negatives, spelling variants and token counts against brute force, with odd rows."""

import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.llm import catalog, hard_negatives, oracles, token_counts, variants
from tabflow.plans.oracle_check import compare, duck_connect
from tabflow.session import scratch_path

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


# ---- hard negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, cluster string, w string, id string"


def _mined(rows):
    """The contract by brute force over (vec_id, vector, label) rows."""
    fine = {(i, tuple(np.floor(256 * np.asarray(v, float)).astype(int)), (l + 1) % 10 if i % 7 == 0 else l)
            for i, v, l in rows if None not in (i, v, l) and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in fine:
        if a[0] % 100:
            continue
        near = sorted((-dot(a[1], b[1]), b[0]) for b in fine if b[2] == a[2] and b != a)[:5]
        far = sorted((-dot(a[1], b[1]), b[0]) for b in fine if b[2] != a[2])
        for ps, p in near:
            fit = [(s, n) for s, n in far if 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out += [(a[0], p, r + 1, n, -ps, -s) for r, (s, n) in enumerate(fit)]
    return Counter(out)


def _vectors(n, seed, dims=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(10, dims))
    label = rng.integers(0, 10, n)
    v = (centre[label] + rng.normal(size=(n, dims))).astype(np.float32) / 4
    return [(i, v[i].tolist(), int(label[i])) for i in range(n)]


def _mine(df):
    v = F.col("vec_id")
    out = hard_negatives.mine(df, v % 100 == 0, F.when(v % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return Counter(tuple(r) for r in out.collect())


def test_negatives_by_brute_force_with_odd_rows(spark, monkeypatch):
    rows = _vectors(1200, 1)
    rows += rows[:40]                                                    # repeated rows
    rows += [(2000 + i, rows[7][1], 3) for i in range(400)]              # a third hold one vector: ties
    rows += [(None, [0.1] * 8, 1), (300, None, 1), (3001, [0.1] * 8, None), (3002, [None] * 8, 1), (3003, [float("nan")] * 8, 1),
             (3004, [float("inf")] * 8, 1), (3100, [0.0] * 8, 2), (3101, [], 2), (3200, [0.3] * 5, 2), (100, [0.2] * 8, 4)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    want = _mined(rows)
    assert len(want) > 500 and _mine(df) == want
    monkeypatch.setattr(hard_negatives, "STEP", 64)                      # many blocks: needs carried from the first ones
    assert _mine(df) == want


def test_negatives_of_small_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not _mine(empty)
    one = spark.createDataFrame([(100, [0.5, 0.5], 1, "x", "x", "x", "x")], SCHEMA)
    assert not _mine(one)


def test_large_components_do_not_overflow(spark):
    rows = [(100, [1e30, 1.0], 1), (101, [1e30, 2.0], 1), (102, [7e4, 0.5], 2)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    assert all(0 < s < 2 ** 62 for *_, s, _ in _mine(df))


def test_a_walk_stops_when_it_is_certified():
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.concatenate([rng.normal([4, 0, 0], 0.1, (50, 3)), rng.normal([-4, 1, 0], 0.1, (20_000, 3))]))
    n = len(x)
    block = hard_negatives.Block(np.arange(n), np.zeros(n, np.int64), np.ones(n, np.int32), x)
    q = np.floor(256 * rng.normal([4, 0, 0], 0.1, (5, 3)))
    centre = np.array([1.0, 0, 0])
    wide = hard_negatives.angles(q, centre[None]).max()
    end = np.full((5, 1), hard_negatives.WIDE)
    row, score, cand, read = hard_negatives.walk(block, *block.order(centre, wide), q, np.arange(5) + n, np.zeros(5, int),
                                                 np.ones(5, int), -end, end, -end, 5, True)
    assert read == 5 * hard_negatives.STEP < 5 * n
    full = (q @ x.T).astype(int)
    for m in range(5):
        assert score[row == m].tolist() == sorted(full[m].tolist(), reverse=True)[:5]


def test_op11_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    r = compare(spark, duck_connect(sf), sf, "op11", catalog.QUERIES["op11_hard_negatives"], oracles.HARD_NEGATIVES)
    assert r["ok"], r["note"]


# ---- spelling variants

def _words(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _forms(words):
    near = {w: [v for v in words if v != w and _one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def test_variants_by_brute_force(make, odd_rows):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 7))) for _ in range(60)]
    texts = []
    for i in range(260):
        words = []
        for _ in range(40):
            w = rng.choice(base[: rng.randint(1, 60)])
            if rng.random() < 0.3:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1:], w[:p] + rng.choice("abcÉé") + w[p:], w[:p] + "b" + w[p + 1:], w.title()])
            words.append(w)
        texts.append((i, " ".join(words)))
    rows = odd_rows + texts + [(900 + i, "Straße " + "q" * 3000 + " " + "q" * 2999) for i in range(3)] * 2
    want = _forms(_words(rows))
    got = variants.variant_forms(variants.vocabulary(make(rows))).collect()
    assert len(got) == len(want) > 200 and {tuple(r) for r in got} == want
    assert sum(r.form is not None for r in got) > 50 and any(r.form and r.root != r.form for r in got)
    assert variants.variant_forms(variants.vocabulary(make([]))).count() == 0
    assert variants.vocabulary(make([(1, None), (2, ""), (3, "four five six")])).count() == 0


def test_filters_in_rounds_and_segments_find_the_same_pairs(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(5, 6))) for _ in range(900)})
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = {(r.word, r.near) for r in variants.near_pairs(vocab, filter_bytes=600, segment=4).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and _one_edit(a, b)}


def test_chains_end_at_their_last_link(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"v{i}", "w5") for i in range(50)],
                                  "word string, form string")
    assert {r.root for r in variants.last_links(links).collect()} == {"w37"}


# ---- token counts

@pytest.fixture(scope="module")
def encoder():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(catalog.vocabulary_file("byte_bpe_50k.json"))


def test_counts_equal_the_library_and_misses_only_are_encoded(spark, make, odd_rows, encoder, monkeypatch):
    file, cache = catalog.vocabulary_file("byte_bpe_50k.json"), scratch_path(spark, "counts-test")
    rows = odd_rows + [(50, "a <|endoftext|> b"), (51, "  two  spaces\r\n")] + [(100 + i, "copied text") for i in range(300)]
    want = Counter((i, len((t or "").encode()), len(encoder.encode(t or "", add_special_tokens=False))) for i, t in rows)
    docs = make(rows).withColumn("n_tokens", F.lit("x"))
    first = token_counts.count_tokens(docs, file, cache, keep=["doc_id"])
    assert Counter(tuple(r) for r in first.collect()) == want
    tokenizer = token_counts.tokenizer_digest(file)
    stored = token_counts.stored_counts(spark, cache, tokenizer).count()
    assert stored == len({t or "" for _, t in rows})
    sent = []
    whole = token_counts.encode_counts
    monkeypatch.setattr(token_counts, "encode_counts", lambda texts, f: (sent.append(texts.count()), whole(texts, f))[1])
    more = make([*rows, (2000, "only this is new"), (2001, "only this is new")])
    again = token_counts.count_tokens(more, file, cache)
    assert sent == [1] and token_counts.stored_counts(spark, cache, tokenizer).count() == stored + 1
    assert again.columns == [c for c in more.columns if c != "text"] + ["n_bytes", "n_tokens"] and again.count() == len(rows) + 2
    assert again.where("doc_id = 2000").first().n_tokens == len(encoder.encode("only this is new").ids)
    assert token_counts.count_tokens(make([]), file, cache).count() == 0


def test_a_digest_stored_twice_is_read_once(spark, make, encoder):
    file, cache = catalog.vocabulary_file("byte_bpe_50k.json"), scratch_path(spark, "counts-twice")
    docs = make([(1, "one"), (2, "two words")])
    token_counts.count_tokens(docs, file, cache).count()
    run = token_counts.stored_counts(spark, cache, token_counts.tokenizer_digest(file))
    run.write.parquet(f"{cache}/tokenizer={token_counts.tokenizer_digest(file)}/run=other")
    assert token_counts.count_tokens(docs, file, cache).count() == 2


def test_other_tokenizers_have_counts_of_their_own(spark, make):
    sentencepiece = pytest.importorskip("sentencepiece")
    cache = scratch_path(spark, "counts-kinds")
    docs = make([(1, "Some text."), (2, None)])
    files = [catalog.vocabulary_file(f) for f in ("piece_bpe_32k.model", "word_bpe_49k.json")]
    a, b = ({r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, f, cache).collect()} for f in files)
    lib = sentencepiece.SentencePieceProcessor(model_file=files[0])
    assert a == {1: len(lib.encode("Some text.")), 2: 0} and b[1] == 3
    with pytest.raises(ValueError):
        token_counts.tokenizer_digest("vocabulary.txt")
