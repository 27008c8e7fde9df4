"""Gated recurrent language model for scoring whole documents.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` (A-Z lowered) and one end mark per document.
The output is class-factored: P(token) = P(class | state) * P(token | class, state).
Frequent words form classes of ``CLASS_SIZE`` by count rank; the end mark is a class;
all other words share a few classes by form (non-ASCII or not, final mark), inside
which a word has its additively smoothed share of the counts.  So every text has a
proper probability.

Counting covers all training documents: documents are dealt into chunks by row
hash; a chunk sends each distinct word once as a row, Spark adds the counts up by
word, and the chunk gets its words back with their totals, so what travels grows with
the distinct words per chunk, not with the tokens or with pairs of chunks.

Training: truncated backpropagation in numpy over windows of ``STEPS`` tokens with
state carried from window to window.  Every training document is learned once (a
``train_share`` below 1 takes that share of them by hash): documents are dealt by hash
into ``rounds`` slices; a slice is cut among trainers that work in parallel from the same
weights, and Spark averages the weights after each round.

Scoring: documents of a chunk run side by side; state is carried across windows from
the first token of a document to its end mark, whatever its length.

Defined cases: null text is empty (one token, the end mark); no training documents:
counts are 0 and the model scores with its starting weights; equal rows get equal
scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabflow.llm.common import n_partitions, row_hash
from tabflow.llm.text import Words, word_slices
from tabflow.session import materialize, scratch_path

SHORTLIST, CLASS_SIZE, EMBED, HIDDEN, STEPS, LANES = 2048, 32, 16, 24, 32, 32
STACK, SIDE, SETTLE = 8, 1024, 1 << 14   # trainers that learn and documents that are scored side by side, tokens at a time
CHUNK_BYTES = 16 << 20
FORMS = 6
_U = np.uint64
END_HASH = _U(0x5851F42D4C957F2D)
F32 = np.float32


# ---------------------------------------------------------------- the model (numpy)

def start_weights(counts: np.ndarray, form_mass: np.ndarray, end_mass: float, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights whose output is the unigram distribution; ``counts`` of the shortlist, descending."""
    rng = np.random.default_rng(seed)
    n_class = max(-(-len(counts) // CLASS_SIZE), 1)
    size = n_class * CLASS_SIZE
    inputs, outputs = size + 1 + FORMS, n_class + 1 + FORMS
    padded = np.zeros(size)
    padded[:len(counts)] = counts
    by_class = padded.reshape(n_class, CLASS_SIZE)
    mass = np.concatenate([by_class.sum(1), [end_mass], form_mass]) + 0.5
    within = np.where(by_class > 0, np.log(np.maximum(by_class, 1)), -30.0)

    def draw(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(F32)

    return {"emb": (0.3 * rng.standard_normal((inputs, EMBED))).astype(F32),
            "wx": draw(EMBED, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, F32),
            "uzr": draw(HIDDEN, 2 * HIDDEN), "uh": draw(HIDDEN, HIDDEN),
            "wc": 0.1 * draw(HIDDEN, outputs), "bc": np.log(mass / mass.sum()).astype(F32),
            "ww": 0.1 * draw(n_class, HIDDEN, CLASS_SIZE), "bw": within.astype(F32)}


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


class Room:
    """Work arrays by name that calls use again and again: a fresh large array costs a page fault for every 4 kB."""

    def __init__(self, kind=F32):
        self.kind, self.held = kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size + size // 4, self.kind)
        return self.held[name][:size].reshape(shape)


def _log_share(x: np.ndarray, at: np.ndarray, room: Room) -> np.ndarray:
    """log softmax of each row at one column; ``x`` is used up.  One common shift serves all rows unless a row lies far
    below it."""
    x -= x.max(initial=0.0)
    total = np.exp(x, out=room("exp", *x.shape)) @ np.ones(x.shape[1], x.dtype)
    if len(total) and total.min() < 1e-30:
        return _log_softmax(x)[np.arange(len(at)), at]
    return x[np.arange(len(at)), at] - np.log(total)


class Layout:
    """Class and place in class of model ids (shortlist, end mark, forms)."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.n_class = len(w["bw"])
        self.end = self.n_class * CLASS_SIZE

    def target_class(self, ids):
        return np.where(ids < self.end, ids // CLASS_SIZE, ids - self.end + self.n_class)


def output_log_prob(w, lay: Layout, h: np.ndarray, ids: np.ndarray, room: Room | None = None) -> np.ndarray:
    """log P(token) of ids given the states before them (a form class counts as its class only)."""
    cls, room = lay.target_class(ids), room or Room(np.result_type(h, w["wc"]))
    lp = np.empty(len(ids))
    for a in range(0, len(ids), 2048):
        part = h[a:a + 2048]
        x = np.matmul(part, w["wc"], out=room("logits", len(part), w["wc"].shape[1]))
        x += w["bc"]
        lp[a:a + 2048] = _log_share(x, cls[a:a + 2048], room)
    words = np.flatnonzero(ids < lay.end)
    if not len(words):
        return lp
    c, place = cls[words], ids[words] % CLASS_SIZE
    if len(words) < 2000:
        logits = np.matmul(h[words][:, None, :], w["ww"][c])[:, 0] + w["bw"][c]
        lp[words] += _log_share(logits, place, room)
        return lp
    order = np.argsort(c, kind="stable")
    edges = np.searchsorted(c[order], np.arange(lay.n_class + 1))
    state, share = np.take(h, words[order], axis=0, out=room("state", len(words), h.shape[1]), mode="clip"), np.empty(len(words))
    place = place[order]
    for k in range(lay.n_class):
        for a in range(edges[k], edges[k + 1], 2048):
            own = slice(a, min(a + 2048, edges[k + 1]))
            x = np.matmul(state[own], w["ww"][k], out=room("logits", own.stop - a, CLASS_SIZE))
            x += w["bw"][k]
            share[own] = _log_share(x, place[own], room)
    lp[words[order]] += share
    return lp


def score_documents(w: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """log P of each document: ``ids[first[d]:first[d+1]]`` are its tokens, the last one the end mark;
    ``extra`` is each token's log share inside its form class (0 for other tokens)."""
    lay = Layout(w)
    table = w["emb"] @ w["wx"] + w["b"]
    table[:, :2 * HIDDEN] *= -1                              # gates are 1 / (1 + exp(-x))
    minus = -w["uzr"]
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    result = np.zeros(len(order))
    for at in range(0, len(order), SIDE):
        own = order[at:at + SIDE]
        result[own] = _score_side_by_side(w, lay, table, minus, ids, first[:-1][own], length[own])
    if len(extra):
        result += np.add.reduceat(extra, first[:-1]) if len(first) > 1 else 0
    return result


def _score_side_by_side(w, lay, table, minus, ids, begin, length) -> np.ndarray:
    """log P of documents in descending order of length, by the model alone."""
    out, room = np.zeros(len(begin)), Room()
    h, states = np.zeros((len(begin), HIDDEN), F32), np.empty((SETTLE + len(begin), HIDDEN), F32)
    targets, owners, held = [], [], 0
    for t in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -t, side="left"))        # documents longer than t
        at = begin[:n] + t
        h, new = h[:n], states[held:held + n]
        if t:
            x = np.take(table, ids[at - 1], axis=0, out=room("x", n, 3 * HIDDEN), mode="clip")
            zr = np.matmul(h, minus, out=room("zr", n, 2 * HIDDEN))
            zr += x[:, :2 * HIDDEN]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            rh = np.multiply(zr[:, HIDDEN:], h, out=room("rh", n, HIDDEN))
            np.matmul(rh, w["uh"], out=new)
            new += x[:, 2 * HIDDEN:]
            np.tanh(new, out=new)
            new -= h
            new *= zr[:, :HIDDEN]
            new += h
        else:
            new[:] = h
        h = new
        targets.append(ids[at])
        owners.append(np.arange(n))
        held += n
        if held >= SETTLE or t + 1 == length[0]:
            lp = output_log_prob(w, lay, states[:held], np.concatenate(targets), room)
            out += np.bincount(np.concatenate(owners), lp, len(out))
            targets, owners, held = [], [], 0
            h = h.copy()                                          # its place is written again
    return out


def train(w: dict[str, np.ndarray], docs: list[np.ndarray], rate: float, seed: int = 0) -> dict[str, np.ndarray]:
    """One pass of truncated backpropagation with Adam over documents (arrays of model ids, end mark last)."""
    return train_many(w, [docs], rate, seed)[0]


def _lanes(docs: list[np.ndarray], end: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a trainer and the tokens before them, (lane, time)."""
    order = np.random.default_rng(seed).permutation(len(docs))
    tokens = np.concatenate([docs[i] for i in order])
    lanes = min(LANES, max(len(tokens) // STEPS, 1))
    per = -(-len(tokens) // lanes)
    target = np.resize(tokens, per * lanes).reshape(lanes, per)             # filled up from the start
    return target, np.hstack([np.full((lanes, 1), end), target[:, :-1]])


def train_many(w: dict[str, np.ndarray], groups: list[list[np.ndarray]], rate: float,
               seed: int = 0) -> list[dict[str, np.ndarray]]:
    """``train`` for several trainers that start from the same weights, side by side: each has its own weights, windows
    and Adam steps; stacked arrays only share the calls."""
    lay, names = Layout(w), list(w)
    data = [_lanes(docs, lay.end, seed) for docs in groups]
    flat = np.concatenate([w[k].ravel() for k in names])
    edges = np.cumsum([0] + [w[k].size for k in names])
    done, room = [None] * len(groups), Room()
    for lanes in sorted({len(target) for target, _ in data}):
        own = sorted((i for i, (target, _) in enumerate(data) if len(target) == lanes),
                     key=lambda i: -data[i][0].shape[1])
        weight = np.tile(flat, (len(own), 1))
        grad, m, v = np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(weight)
        h = np.zeros((len(own), lanes, HIDDEN), weight.dtype)
        length = [data[i][0].shape[1] for i in own]

        def parts(a, lo, hi, edges=edges):
            return {k: a[lo:hi, edges[j]:edges[j + 1]].reshape(hi - lo, *w[k].shape) for j, k in enumerate(names)}

        for step, t0 in enumerate(range(0, length[0], STEPS), 1):
            whole = sum(n - t0 >= STEPS for n in length)
            live = sum(n > t0 for n in length)
            # a last, shorter window is a trainer's own
            for lo, hi in ([(0, whole)] if whole else []) + [(i, i + 1) for i in range(whole, live)]:
                x_id, y = (np.stack([data[i][k][:, t0:t0 + STEPS].T for i in own[lo:hi]]) for k in (1, 0))
                _, h[lo:hi] = _windows(parts(weight, lo, hi), lay, x_id, y, h[lo:hi], parts(grad, lo, hi), room)
                for i in range(lo, hi):
                    _adam(weight[i], grad[i], m[i], v[i], rate, step)
        for row, i in enumerate(own):
            done[i] = {k: a[0] for k, a in parts(weight, row, row + 1).items()}
    return done


def _adam(w, g, m, v, rate: float, step: int) -> None:
    """One Adam step in place with the gradient's norm cut at 1; ``g`` is used up."""
    clip = min(1.0, 1.0 / max(float(np.sqrt(np.dot(g, g))), 1e-9))
    up, root = 1 - 0.9 ** step, np.sqrt(1 - 0.99 ** step)
    for a in range(0, len(w), BLOCK):                        # stays in the cache from first to last
        at = slice(a, a + BLOCK)
        _adam_block(w[at], g[at], m[at], v[at], F32(0.1 * clip), F32(1e-6 * root), F32(rate * root / up))


def _adam_block(w, g, m, v, cut, least, pace) -> None:
    g *= cut
    m *= F32(0.9)
    m += g
    g *= g                                                   # 0.01 times the square of the cut gradient
    v *= F32(0.99)
    v += g
    np.sqrt(v, out=g)
    g += least
    np.divide(m, g, out=g)
    g *= pace
    w -= g


def _softmax(x: np.ndarray, scale, e: np.ndarray) -> np.ndarray:
    """softmax of the last axis times ``scale`` (one number, or one a row) in ``e``; ``x`` is used up.  One common shift
    serves all rows unless a row lies far below it."""
    x -= x.max(initial=0.0)
    ones = np.ones(x.shape[-1], x.dtype)
    np.exp(x, out=e)
    total = (e.reshape(-1, x.shape[-1]) @ ones).reshape(x.shape[:-1])
    if total.size and total.min() < 1e-30:
        x -= x.max(-1, keepdims=True)
        np.exp(x, out=e)
        total = e.sum(-1)
    e *= (scale / total).astype(x.dtype)[..., None]
    return e


def _window(w, lay, x_id, y, h):
    """Gradients of the mean token loss over one window (time, lane), and the state after it."""
    grad = {k: np.zeros_like(a)[None] for k, a in w.items()}
    grad, h = _windows({k: a[None] for k, a in w.items()}, lay, x_id[None], y[None], h[None], grad,
                       Room(w["wx"].dtype))
    return {k: a[0] for k, a in grad.items()}, h[0]


def _apart(a: np.ndarray, k: int) -> np.ndarray:
    """``k`` equal parts of the last axis as a first axis."""
    return np.ascontiguousarray(np.moveaxis(a.reshape(*a.shape[:-1], k, -1), -2, 0))


def _sorted_order(key: np.ndarray, limit: int) -> np.ndarray:
    """Stable order of whole numbers below ``limit``; two bytes are sorted by digit."""
    return np.argsort(key.astype(np.uint16) if limit <= 1 << 16 else key, kind="stable")


def _windows(w, lay, x_id, y, h, g, room):
    """Gradients (into ``g``) of the mean token loss over one window of each trainer, and the states after it; all arrays
    have the trainer first, ids are (trainer, time, lane)."""
    many, steps, lanes = x_id.shape
    n, hid, kind = steps * lanes, HIDDEN, w["wx"].dtype
    who, flat_x = np.arange(many)[:, None], x_id.reshape(many, n)
    e = w["emb"][who, flat_x]
    # gates z, r and the candidate c lie apart, so that the arrays of a step are whole
    wx, b, uzr = _apart(w["wx"], 3), _apart(w["b"][:, None], 3), _apart(w["uzr"], 2)
    x = np.matmul(e, wx, out=room("x", 3, many, n, hid))
    x += b
    gates, c = x[:2].reshape(2, many, steps, lanes, hid), x[2].reshape(many, steps, lanes, hid)
    np.negative(gates, out=gates)                            # becomes z and r
    minus, fresh = np.negative(uzr), x_id == lay.end
    keep, begins = (~fresh).astype(kind)[..., None], fresh.any((0, 2)).tolist()
    hp, rh, step, hs, stay, to_c, to_z, to_r = (room(k, many, steps, lanes, hid) for k in
                                                ("hp", "rh", "step", "hs", "stay", "to_c", "to_z", "to_r"))
    add, drh = room("add", 2, many, lanes, hid), room("drh", many, lanes, hid)
    for t in range(steps):
        p, zr, ct = hp[:, t], gates[:, :, t], c[:, t]
        p[...] = h
        if begins[t]:
            p *= keep[:, t]                                  # a new document starts from the zero state
        zr += np.matmul(p, minus, out=add)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        ct += np.matmul(np.multiply(zr[1], p, out=rh[:, t]), w["uh"], out=drh)
        np.tanh(ct, out=ct)
        h = np.multiply(zr[0], np.subtract(ct, p, out=step[:, t]), out=hs[:, t])
        h += p
        if begins[t]:
            h *= keep[:, t]                                  # scoring starts from zero, unmoved by the mark
    flat, ids = hs.reshape(many, n, hid), y.reshape(many, n)
    cls = lay.target_class(ids)
    dh_out, ones = room("dh", many, n, hid), np.ones(n, kind)
    for i in range(many):
        d = np.matmul(flat[i], w["wc"][i], out=room("logits", n, w["wc"].shape[2]))
        d += w["bc"][i]
        d = _softmax(d, 1 / n, room("d", *d.shape))
        d[np.arange(n), cls[i]] -= kind.type(1 / n)
        np.matmul(flat[i].T, d, out=g["wc"][i])
        np.matmul(ones, d, out=g["bc"][i])
        np.matmul(d, w["wc"][i].T, out=dh_out[i])
    _class_gradients(w, lay, flat, ids, cls, dh_out, g, room)
    dh_out = dh_out.reshape(many, steps, lanes, hid)
    z, r = gates
    np.subtract(1, z, out=stay)
    np.multiply(c, c, out=to_c)
    np.subtract(1, to_c, out=to_c)
    to_c *= z
    np.multiply(step, z, out=to_z)
    to_z *= stay
    np.subtract(1, r, out=to_r)
    to_r *= rh
    dx, back = room("dx", 3, many, steps, lanes, hid), np.zeros((many, lanes, hid), kind)
    uh, uzr = w["uh"].swapaxes(1, 2), uzr.swapaxes(2, 3)
    for t in range(steps - 1, -1, -1):
        dh, to = dh_out[:, t], dx[:, :, t]
        dh += back
        if begins[t]:
            dh *= keep[:, t]
        np.matmul(np.multiply(dh, to_c[:, t], out=to[2]), uh, out=drh)
        np.multiply(dh, to_z[:, t], out=to[0])
        np.multiply(drh, to_r[:, t], out=to[1])
        np.matmul(to[:2], uzr, out=add)
        drh *= r[:, t]
        dh *= stay[:, t]
        np.add(add[0], add[1], out=back)
        back += drh
        back += dh
    dx = dx.reshape(3, many, n, hid)
    g["uh"][...] = np.matmul(rh.reshape(many, n, hid).swapaxes(1, 2), dx[2])
    hp, e_t = hp.reshape(many, n, hid).swapaxes(1, 2), e.swapaxes(1, 2)
    for k in range(3):
        at = slice(k * hid, (k + 1) * hid)
        g["wx"][..., at], g["b"][..., at] = np.matmul(e_t, dx[k]), np.matmul(ones, dx[k])
        if k < 2:
            g["uzr"][..., at] = np.matmul(hp, dx[k])
    inputs = w["emb"].shape[1]
    key = (who * inputs + flat_x).ravel()
    order = _sorted_order(key, many * inputs)
    key = key[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    d_emb, wx = np.matmul(dx[0], wx[0].swapaxes(1, 2), out=room("d_emb", *e.shape)), wx.swapaxes(2, 3)
    for k in (1, 2):
        d_emb += np.matmul(dx[k], wx[k], out=room("more", *e.shape))
    d_emb = d_emb.reshape(many * n, -1)[order]
    g["emb"][...] = 0
    g["emb"][key[head] // inputs, key[head] % inputs] = np.add.reduceat(d_emb, head)
    return g, h


def _class_gradients(w, lay, flat, ids, cls, dh_out, g, room) -> None:
    """Adds the words' part inside their class.  The (trainer, class) pairs of a window that have about as many words are
    one padded batch: up to twice the words, a few calls instead of some for each class."""
    many, n, hid = flat.shape
    g["ww"][...], g["bw"][...] = 0, 0
    ids = ids.ravel()
    word = np.flatnonzero(ids < lay.end)
    if not len(word):
        return
    pair = (word // n) * lay.n_class + cls.ravel()[word]
    word = word[_sorted_order(pair, many * lay.n_class)]
    count = np.bincount(pair, minlength=many * lay.n_class)
    start = np.cumsum(count) - count
    present = np.flatnonzero(count)
    size = np.ceil(np.log2(count[present])).astype(np.int64)
    state, dh = flat.reshape(many * n, hid), dh_out.reshape(many * n, hid)
    for k in np.unique(size).tolist():
        own = present[size == k]
        slot = np.arange(count[own].max())
        real = slot < count[own][:, None]
        at = word[np.minimum(start[own][:, None] + slot, len(word) - 1)]
        who, c = own // lay.n_class, own % lay.n_class
        u = w["ww"][who, c]
        x = np.take(state, at, axis=0, out=room("state", *at.shape, hid), mode="clip")
        e = np.matmul(x, u, out=room("logits", *at.shape, CLASS_SIZE))
        e += w["bw"][who, c][:, None]
        e = _softmax(e, real / n, room("d", *e.shape))
        mine, place = at[real], np.flatnonzero(real)
        e.ravel()[place * CLASS_SIZE + ids[mine] % CLASS_SIZE] -= e.dtype.type(1 / n)
        g["ww"][who, c] = np.matmul(x.swapaxes(1, 2), e)
        g["bw"][who, c] = np.matmul(np.ones(len(slot), e.dtype), e)
        back = np.matmul(e, u.swapaxes(1, 2), out=room("back", *x.shape))
        dh[mine] += back.reshape(-1, hid)[place]


# ---------------------------------------------------------------- words of chunks

#: Final mark by last byte: none (letter, digit or non-ASCII), full stop, other.
_MARK = np.full(256, 2, np.uint8)
_MARK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 0
_MARK[46] = 1


def _forms(words: Words) -> np.ndarray:
    """Form class of each word: non-ASCII or not, and final mark (none, full stop, other)."""
    mark = _MARK[words.buf[words.end - 1]]
    if words.buf.max(initial=0) < 128:
        return mark
    foreign = np.zeros(len(words.buf) + 1, np.int32)
    np.cumsum(words.buf >= 128, out=foreign[1:])
    return mark + np.uint8(3) * (foreign[words.end] > foreign[words.start])


def _chunk_words(text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of a chunk (end mark included), their forms, every token's index, and document bounds."""
    hashes, forms, counts = [], [], []
    for _, _, w in word_slices(text, lower=True):
        hashes.append(w.hash)
        forms.append(_forms(w))
        counts.append(np.diff(w.first))
    n = np.concatenate(counts) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    alls = np.full(first[-1], END_HASH, np.uint64)
    kind = np.zeros(first[-1], np.uint8)
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    alls[inner] = np.concatenate(hashes)
    kind[inner] = np.concatenate(forms)
    index, found = pd.factorize(alls)
    form = np.zeros(len(found), np.uint8)
    form[index] = kind
    order = np.argsort(found)
    place = np.empty(len(found), np.int32)
    place[order] = np.arange(len(found))
    return found[order], form[order], place[index], first


_PAIRS = "chunk int, hash long, form int, n long"


def _count_chunk(key, t):
    """One row per distinct word of a chunk, with its count in the training documents."""
    uniq, form, index, first = _chunk_words(t.column("text"))
    learn = np.repeat(t.column("learn").to_numpy(), np.diff(first))
    n = np.bincount(index[learn], minlength=len(uniq))
    return pa.table({"chunk": pa.array(np.full(len(uniq), key[0].as_py(), np.int32)),
                     "hash": pa.array(uniq.astype(np.int64)), "form": pa.array(form.astype(np.int32)),
                     "n": pa.array(n, pa.int64())})


def count_words(rows: DataFrame) -> DataFrame:
    """Rows (chunk, hash, form, total, head) of each chunk's distinct words with the count of the word in all training
    documents; ``head`` marks one row of each word.  Stored, with one shuffle by word: its size is the sum of the chunks'
    distinct words, so it grows with the chunks, not with their square; a word that every chunk has is one row a chunk."""
    word = Window.partitionBy("hash")
    pairs = rows.select("chunk", "learn", "text").groupBy("chunk").applyInArrow(_count_chunk, _PAIRS)
    found = pairs.select("chunk", "hash", "form", F.sum("n").over(word).alias("total"),
                         (F.col("chunk") == F.min("chunk").over(word)).alias("head"))
    path = scratch_path(rows.sparkSession, "lm-words")
    found.write.parquet(path)
    return rows.sparkSession.read.schema("chunk int, hash long, form int, total long, head boolean").parquet(path)


class Vocabulary:
    """Shortlist and totals; maps a chunk's distinct words to model ids and log shares."""

    def __init__(self, top: list, totals: list):
        self.hash = np.array([r["hash"] for r in top], np.int64).astype(np.uint64)
        self.count = np.array([r["n"] for r in top], np.int64)
        form = np.array([r["form"] for r in top], np.int64)
        self.n = sum(r["n"] for r in totals)
        self.v = sum(r["v"] for r in totals)
        self.end_count = sum(r["n"] for r in totals if r["form"] == -1)
        n_f, v_f = np.zeros(FORMS), np.zeros(FORMS)
        for r in totals:
            if r["form"] >= 0:
                n_f[r["form"]] += r["n"]
                v_f[r["form"]] += r["v"]
        n_f -= np.bincount(form, self.count, FORMS) if len(form) else 0
        v_f -= np.bincount(form, minlength=FORMS) if len(form) else 0
        n_f = np.maximum(n_f, 0)
        self.form_mass = n_f
        self.form_total = n_f + 0.1 * v_f + 0.1
        self.order = np.argsort(self.hash)
        self.sorted = self.hash[self.order]
        # by the leading 16 bits of a hash: the first word that has them, and how many have
        self.slot = np.searchsorted(self.sorted >> _U(48), np.arange(1 << 16, dtype=np.uint64)).astype(np.int32)
        self.held = np.bincount((self.sorted >> _U(48)).astype(np.int64), minlength=1 << 16).astype(np.int32)
        self.slot[self.held == 0] = 0
        self.end = max(-(-len(self.hash) // CLASS_SIZE), 1) * CLASS_SIZE

    def ids(self, uniq: np.ndarray, form: np.ndarray) -> np.ndarray:
        out = self.end + 1 + form.astype(np.int64)
        if len(self.hash):
            lead = (uniq >> _U(48)).astype(np.int32)
            at = self.slot[lead]
            found = self.sorted[at] == uniq
            for k in range(1, int(self.held.max())):
                rest = np.flatnonzero(self.held[lead] > k)
                rest = rest[~found[rest]]
                at[rest] += 1
                found[rest] = self.sorted[at[rest]] == uniq[rest]
            out = np.where(found, self.order[at], out)
        return np.where(uniq == END_HASH, self.end, out)

    def shares(self, ids: np.ndarray, form: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log share of a word in its form class; 0 for the shortlist and the end mark."""
        return np.where(ids > self.end, np.log((count + 0.1) / self.form_total[form]), 0.0)

    def start(self) -> dict[str, np.ndarray]:
        return start_weights(self.count, self.form_mass, self.end_count)


def _chunked(docs: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(id_col, text_col).alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.coalesce(learn, F.lit(False)).alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(int(size // CHUNK_BYTES) + 1, 2)
    return rows.withColumn("chunk", F.pmod("key", F.lit(chunks)).cast("int"))


BLOCK = 8192


def _weight_blocks(w: dict, names: list, docs: list) -> pa.RecordBatch:
    """A trainer's weights in blocks, with the number of tokens they were trained on."""
    flat = np.concatenate([w[k].ravel() for k in names]).astype(F32)
    blocks = [flat[i:i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
    share = float(sum(map(len, docs)))
    return pa.record_batch([pa.array(range(len(blocks)), pa.int32()), pa.array([share] * len(blocks)),
                            pa.array(blocks, pa.binary())], names=["block", "share", "x"])


def _mean_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block -> the mean of each block, weighted by tokens, added up while streaming."""
    def out(block, share, x):
        return pa.record_batch([pa.array([block], pa.int32()), pa.array([share]),
                                pa.array([(x / share).tobytes()], pa.binary())], names=["block", "share", "x"])
    now, share, total = None, 0.0, None
    for batch in batches:
        for block, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now:
                if now is not None:
                    yield out(now, share, total)
                now, share, total = block, 0.0, 0.0
            share, total = share + n, total + n * np.frombuffer(x, F32).astype(np.float64)
    if now is not None:
        yield out(now, share, total)


def fit_weights(rows: DataFrame, vocab: Vocabulary, train_share: float, rounds: int, rate: float) -> dict:
    """Weights after one pass over the hash share of the ``learn`` rows, in ``rounds`` slices: trained in parallel,
    averaged by Spark."""
    spark, weights = rows.sparkSession, vocab.start()
    u = F.xxhash64(F.lit("gru"), F.col("key")).cast("double") / 2.0 ** 64 + 0.5
    picked = rows.filter("learn").filter(u < train_share).select("key", "text")

    def encode(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, j, w in word_slices(batch.column(1), lower=True):
                ids = vocab.ids(w.hash, _forms(w)).astype(np.int32)
                out = [np.append(ids[a:b], vocab.end).astype(np.int32).tobytes()
                       for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.record_batch([pa.array(keys[i:j], pa.int64()), pa.array(out, pa.binary())],
                                      names=["key", "ids"])

    sample = materialize(picked.mapInArrow(encode, "key long, ids binary"))
    tokens = (sample.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 4
    trainers = max(int(tokens // (200_000 * rounds)), 1)
    # a trainer is a group of documents by row hash, not a partition: its result does not depend on where it runs
    placed = sample.withColumn("trainer", F.pmod("key", F.lit(trainers)).cast("int")) \
        .withColumn("stack", F.floor(F.col("trainer") / STACK)) \
        .withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), F.col("key")), F.lit(rounds)).cast("int"))
    names = sorted(weights)
    shapes = {k: weights[k].shape for k in names}

    for r in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def work(batches, sent=sent, r=r):
            def learned(groups):
                found = train_many(sent.value, groups, rate / (1 + r), seed=r)
                return [_weight_blocks(w, names, docs) for w, docs in zip(found, groups, strict=True)]

            now, groups = None, []
            for batch in batches:
                for trainer, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if trainer != now:
                        if groups and (len(groups) == STACK or trainer // STACK != now // STACK):
                            yield from learned(groups)
                            groups = []
                        now = trainer
                        groups.append([])
                    groups[-1].append(np.frombuffer(ids, np.int32))
            if groups:
                yield from learned(groups)

        dealt = placed.filter(F.col("slice") == r).repartition(-(-trainers // STACK), "stack") \
            .sortWithinPartitions("trainer", "key", "ids")
        made = dealt.select("trainer", "ids").mapInArrow(work, "block int, share double, x binary")
        mean = (made.repartition(n_partitions(spark), "block").sortWithinPartitions("block")
                .mapInArrow(_mean_blocks, "block int, share double, x binary").collect())
        if not mean:                                         # no document in this slice
            continue
        flat = np.concatenate([np.frombuffer(m["x"], np.float64) for m in sorted(mean, key=lambda m: m["block"])])
        at, weights = 0, {}
        for k in names:
            size = int(np.prod(shapes[k]))
            weights[k] = flat[at:at + size].reshape(shapes[k]).astype(F32)
            at += size
    return weights


def score_table(docs: DataFrame, learn: Column, shortlist: int = SHORTLIST, train_share: float = 1.0,
                rounds: int = 4, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities)."""
    spark = docs.sparkSession
    rows = _chunked(docs, learn, id_col, text_col)
    words = count_words(rows)
    end = int(END_HASH.astype(np.int64))
    heads = words.filter("head")
    totals = heads.groupBy(F.when(F.col("hash") == end, F.lit(-1)).otherwise(F.col("form")).alias("form")).agg(
        F.sum("total").alias("n"), F.count_if(F.col("total") > 0).alias("v")).collect()
    top = (heads.filter((F.col("total") > 1) & (F.col("hash") != end)).orderBy(F.desc("total"), "hash").limit(shortlist)
           .select("hash", F.col("total").alias("n"), "form").collect())
    vocab = Vocabulary(top, totals)
    weights = fit_weights(rows, vocab, train_share, rounds, rate)
    sent = spark.sparkContext.broadcast((vocab, weights))
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(left, right):
        vocab, weights = sent.value
        uniq, form, index, first = _chunk_words(left.column("text"))
        order = np.argsort(right.column("hash").to_numpy().astype(np.uint64))    # as the chunk's words are sorted
        count = right.column("total").to_numpy()[order]
        ids = vocab.ids(uniq, form)
        base = np.log10((count + 0.1) / (vocab.n + 0.1 * (vocab.v + 1)))
        at = first[:-1]
        lp = score_documents(weights, ids.astype(np.int32)[index], first,
                             vocab.shares(ids, form, count)[index])
        return pa.table([left.column("doc_id"), pa.array(np.diff(first), pa.int64()),
                         pa.array(np.add.reduceat((count > 0)[index].astype(np.int64), at), pa.int64()),
                         pa.array(np.full(len(at), vocab.n), pa.int64()),
                         pa.array(np.add.reduceat(base[index], at)), pa.array(lp / np.log(10))], names=names)

    back = words.select("chunk", "hash", "total")
    return (rows.select("chunk", "doc_id", "text").groupBy("chunk").cogroup(back.groupBy("chunk"))
            .applyInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, "
                               "base_score double, score double"))
