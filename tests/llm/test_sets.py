"""Substring dedup, Jaccard join and decontamination against brute force, on random and odd rows."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tabflow.llm import decontaminate, jaccard, superkmers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed, n=60):
    """Texts over few words with shared passages, copies and near copies."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    passage = [rng.choice(vocab) for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and texts:
            t = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(vocab)
        else:
            t = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.4:
                t += passage
        texts.append(" ".join(t))
    return [(i * 3, t) for i, t in enumerate(texts)]


def brute_repeats(rows, width=13):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    least = {}
    for i, w in words:
        for p in range(len(w) - width + 1):
            k = tuple(w[p:p + width])
            least[k] = min(least.get(k, float("inf")), order(i))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - width + 1):
            if least[tuple(w[p:p + width])] < order(i):
                gone |= set(range(p, p + width))
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found_repeats(df, **options):
    got = superkmers.remove_repeats(df, digest=True, **options).collect()
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_repeats_match_brute_force(make, seed):
    rows = corpus(seed)
    assert found_repeats(make(rows)) == brute_repeats(rows)


def test_repeats_on_odd_rows(make, odd_rows):
    assert found_repeats(make(odd_rows)) == brute_repeats(odd_rows)
    assert superkmers.remove_repeats(make([])).count() == 0
    kept = {r.doc_id: r.kept_text for r in superkmers.remove_repeats(make(odd_rows)).collect()}
    assert kept[2] == "" and kept[11] == "one two three"


def test_repeats_flush_and_bucket_bounds(make, monkeypatch):
    """Many small flushes give the same result as one."""
    monkeypatch.setattr(superkmers, "FLUSH_BYTES", 300)
    rows = corpus(5, 80)
    assert found_repeats(make(rows)) == brute_repeats(rows)


def brute_components(rows, size=5, percent=75):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(UPPER))
        sets.append((i, {tuple(w[p:p + size]) for p in range(max(len(w) - size, 0) + 1)} if w else set()))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    by_id = {}
    for a, (i, s) in enumerate(sets):
        for b in range(a):
            t = sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                up[top(a)] = top(b)
    order = lambda i: float("inf") if i is None else i
    for a, (i, _) in enumerate(sets):
        by_id.setdefault(top(a), []).append(i)
    return sorted([(i, len(s), min(by_id[top(a)], key=order) if s else i) for a, (i, s) in enumerate(sets)], key=str)


def found_components(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()], key=str)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_match_brute_force(make, seed):
    rows = corpus(seed, 90)
    assert found_components(make(rows)) == brute_components(rows)


def test_components_need_the_boundary(make):
    """A chain of texts, each linked to the next only: rings and replication must find every link."""
    rng = random.Random(9)
    words = [f"t{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(words[6 * i:6 * i + 60])) for i in range(40)]
    rows += [(100 + i, " ".join(words[:60] + [f"u{i}"] * 3)) for i in range(20)]
    rng.shuffle(rows)
    assert found_components(make(rows)) == brute_components(rows)


def test_components_meet_below_a_much_longer_pivot(make):
    """Two near copies whose passage a document four times as long holds, which has the smaller share of own shingles."""
    passage, rest = [f"a{i}" for i in range(104)], [f"b{i}" for i in range(300)]
    x, y = list(passage), list(passage)
    x[20], y[80] = "other", "changed"
    rows = [(1, " ".join(x)), (2, " ".join(y)), (3, " ".join(passage + rest))]
    rows += [(k, " ".join(rest + [f"c{k}x{i}" for i in range(60)])) for k in (4, 5, 6, 7)]
    want = brute_components(rows)
    assert [w[2] for w in want] == [1, 1, 3, 4, 5, 6, 7]
    assert found_components(make(rows)) == want


@pytest.mark.parametrize("seed", [20, 21])
def test_components_of_mixed_sizes(make, seed):
    """Near copies and cuts of passages of many lengths, also at the edge of the threshold, inside longer documents."""
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"g{g}x{i}" for i in range(rng.choice([8, 20, 60, 200]))]
        for _ in range(6):
            t = base[:rng.choice([len(base), 4 + -(-3 * (len(base) - 4) // 4), rng.randint(5, len(base))])]
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                t = t + [f"h{g % 3}x{i}" for i in range(rng.choice([30, 300]))]
            rows.append((len(rows), " ".join(t)))
    assert found_components(make(rows)) == brute_components(rows)


def test_components_with_small_flushes_and_tiles(make, monkeypatch):
    """Many flushes, and cells cut into many tiles, give the same result."""
    monkeypatch.setattr(jaccard, "FLUSH", 100)
    monkeypatch.setattr(jaccard, "TILE", 2)
    rng = random.Random(12)
    base = [f"b{i}" for i in range(50)]
    rows = []
    for i in range(60):                                    # near copies around one text, some beyond the radius
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(20)}"
        rows.append((i, " ".join(t)))
    assert found_components(make(rows)) == brute_components(rows)


def test_a_bucket_is_counted_in_little_memory():
    """Merging and counting the postings of a hash bucket holds less than 50 bytes for each of them."""
    rng = np.random.default_rng(1)

    def blob(k):
        h = np.concatenate([rng.integers(0, 2 ** 62, 1500), rng.integers(0, 3000, 1500)]).astype(np.uint64)
        return jaccard.pack(np.arange(500 * k, 500 * k + 500, dtype=np.uint64), np.full(500, 60),
                            rng.integers(0, 500, 3000), np.sort(h))

    batch = pa.record_batch([pa.array([3] * 60, pa.int32()), pa.array([blob(k) for k in range(60)], pa.binary())],
                            names=["bucket", "blob"])
    tracemalloc.start()
    try:
        found = list(jaccard._count_points(8)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in found) == 8
    assert peak < 50 * 60 * 3000


def test_components_on_odd_rows(make, odd_rows):
    assert found_components(make(odd_rows)) == brute_components(odd_rows)
    assert jaccard.jaccard_components(make([])).count() == 0
    kept = jaccard.keep_one(make(odd_rows))
    assert kept.columns == make([]).columns
    ids = sorted([r.doc_id for r in kept.collect()], key=str)
    assert ids == sorted([1, 2, 3, 4, 4, 6, 7, 8, 9, 11, 13], key=str)


def brute_contamination(rows, items, width=13):
    words = lambda t: TERM.findall((t or "").translate(UPPER))
    out = []
    wins = [(str(k) if k is not None else "", words(t)) for k, t in items]
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for k, q in wins:
            n = min(width, len(q))
            if not n:
                continue
            for s in range(len(q) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == q[s:s + n]:
                        hit |= set(range(p, p + n))
                        names.add(k)
        out.append((i, len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination_matches_brute_force(spark, make, odd_rows):
    rows = corpus(3, 40) + odd_rows[:9] + odd_rows[11:]
    items = [(1, " ".join(rows[2][1].split()[:20])), (2, "w1 w2"), (3, None), (4, ""), (10, rows[5][1]), (None, "one TWO three"),
             (10, rows[5][1]), (11, " ".join(f"w{i % 40}" for i in range(14))), (12, "nowhere to be found")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS term", "1 AS start")
    got = decontaminate.contamination(make(rows), bench).collect()
    found = sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got], key=str)
    assert found == brute_contamination(rows, items)
    clean = decontaminate.keep_clean(make(rows), bench)
    assert clean.columns == make([]).columns
    want = sorted([x[0] for x in found if not x[4]], key=str)
    assert sorted([r.doc_id for r in clean.collect()], key=str) == want
    none = bench.limit(0)
    assert decontaminate.contamination(make(rows), none).filter("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.contamination(make([]), bench).count() == 0


def test_proximity_finds_moved_words(spark, make):
    item = "the quick brown fox jumps over the lazy dog near a river bank"
    rows = [(1, "well " + item), (2, "the quick very brown fox then jumps over the lazy dog near a river bank"),
            (3, "a bank and a fox and a dog, nothing else here at all to see or to read")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = make(rows)
    from tabflow.llm.common import row_hash
    ids = {r.k: r.doc_id for r in docs.select("doc_id", row_hash("doc_id", "text").alias("k")).collect()}
    near = {ids[r.key] for r in decontaminate.proximity_matches(docs, bench, slop=4).collect()}
    assert near == {1, 2}


def brute_proximity(rows, items, slop, width=13):
    words = lambda t: TERM.findall((t or "").translate(UPPER))
    out = set()
    for i, t in rows:
        d = words(t)
        for k, q in ((k, words(t)) for k, t in items):
            n = min(width, len(q))
            for s in range(len(q) - n + 1) if n else ():
                at = [{p - j for p, w in enumerate(d) if w == q[s + j]} for j in range(n)]
                if any(all(any(b <= x <= b + slop for x in own) for own in at) for b in set().union(*at)):
                    out.add((i, str(k), s, n))
    return out


@pytest.mark.parametrize("slop", [0, 1, 3, 8])
def test_proximity_matches_brute_force(spark, make, slop):
    """Passages with words moved, put in and left out, repeated words, and words before a document's start."""
    rng = random.Random(31)
    items = [(1, " ".join(f"a{i}" for i in range(16))), (2, "b1 b2 b1 b3 b2 b1"), (3, "c1"), (4, None), (5, ""),
             (6, " ".join(f"e{rng.randrange(5)}" for _ in range(13))), (7, "c1 nowhere")]
    rows = [(0, None), (1, ""), (2, "A3 a2 a1 a0 a5 a4 a6 a7 a8 a9 a10 a11 a12 a13 a15 a14")]
    for i in range(3, 40):
        t = rng.choice(items[:2] + items[5:6])[1].split()
        for _ in range(rng.randint(0, 6)):
            j = rng.randrange(len(t))
            edit = rng.choice(["swap", "put", "drop"])
            if edit == "swap" and j:
                t[j - 1], t[j] = t[j], t[j - 1]
            elif edit == "put":
                t.insert(j, rng.choice(["x", "c1", t[j]]))
            elif edit == "drop" and i % 3 == 0 and len(t) > 2:
                del t[j]
        rows.append((i, " ".join(["x"] * rng.randint(0, 3) + t + ["y"] * rng.randint(0, 2))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    from tabflow.llm.common import row_hash
    docs = make(rows)
    ids = {r.k: r.doc_id for r in docs.select("doc_id", row_hash("doc_id", "text").alias("k")).collect()}
    found = decontaminate.proximity_matches(docs, bench, slop=slop).collect()
    want = brute_proximity(rows, items, slop)
    assert {(ids[r.key], r.item_id, r.start, r.len) for r in found} == want and len(found) == len(want) > 5
    assert decontaminate.proximity_matches(make([]), bench, slop=slop).count() == 0
    assert decontaminate.proximity_matches(docs, bench.limit(0), slop=slop).count() == 0
