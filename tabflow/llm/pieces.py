"""SentencePiece (merge-type) encoding and decoding, exact.

A merge tokenizer joins adjacent symbols, best score first, leftmost first.  Its
result is the only token sequence in which every adjacent pair of tokens is
*compatible*: merging the pair's own characters from scratch gives the pair back.
Encoding therefore needs no merging of the whole text.  An Aho-Corasick automaton
gives the longest vocabulary match at every place; the encoder takes it if it is
compatible with the token before, else the next shorter match, and steps back when
none is left.  Places from which no continuation exists are set in a bitfield and
never entered again, so the work is linear in the text.  Compatibility is decided
by re-merging the two tokens' characters and remembered.

No token crosses a place where a space follows another character, or a letter is followed
by a character that no entry has after a letter (most punctuation), or a character that
occurs in no longer token; text is cut there first and the pieces' ids are
kept in two bounded caches (cleared when full), as words repeat: pieces met once, and
pieces met again, which the stream of rare ones cannot push out.

Defined cases: null text is empty; an empty text is begin and end only; characters
outside the vocabulary become their UTF-8 byte tokens; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHE_ITEMS = 200_000                   # pieces kept (half of them met once); twice as many pairs


#: Letters and digits after which a piece may end.
LATIN = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_LATIN = re.compile(f"[{LATIN}]")


class _Single(dict):
    """Ids of single characters; -1 for others."""

    def __missing__(self, key: str) -> int:
        return -1


class PieceCodec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, blob: bytes | None = None):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as model_pb
        spec = model_pb.ModelProto()
        if blob is None:
            with open(path, "rb") as f:
                blob = f.read()
        spec.ParseFromString(blob)
        self.dummy_prefix = spec.normalizer_spec.add_dummy_prefix
        self.bos, self.eos = spec.trainer_spec.bos_id, spec.trainer_spec.eos_id
        self.surface = [p.piece for p in spec.pieces]
        normal = {p.piece: (i, p.score) for i, p in enumerate(spec.pieces) if p.type in (1, 4)}
        self.id_of = {p: i for p, (i, _) in normal.items()}
        self.score = {p: s for p, (_, s) in normal.items()}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i, p in enumerate(spec.pieces) if p.type in (2, 3)}
        joined = {c for p in normal if len(p) > 1 for c in p}
        inner = any(SPACE in p.lstrip(SPACE) for p in normal)
        barriers = [c for c in "\n\t\r" if c not in joined]
        #: Cut before a run of spaces, around characters that never merge, and after a Latin letter or digit
        #: before a character that follows none in any entry (punctuation).
        after = {c for p in normal for a, c in zip(p, p[1:]) if _LATIN.match(a)}
        stop = "".join(map(re.escape, barriers))
        glued = "".join(re.escape(c) for c in sorted(after) if not _LATIN.match(c) and c not in (SPACE, *barriers))
        other = f"[^{SPACE}{stop}{LATIN}]*"
        more = f"(?:[{glued}]{other}[{LATIN}]*)*" if glued else ""
        if inner:
            self.cut = re.compile(r"[\s\S]+")
        else:
            self.cut = re.compile((f"[{stop}]|" if stop else "") +
                                  f"{SPACE}*{other}[{LATIN}]+{more}|{SPACE}*[^{SPACE}{stop}{LATIN}]+|{SPACE}+")
        #: Only entries that merging their own characters gives; others never come out of the rule.
        self.reachable = {p for p in normal if len(p) == 1 or self.merge(p) == [p]}
        self.trie = ahocorasick.Automaton()
        self.size = [1] * (len(self.surface) + 1)         # the last stands for a character outside the vocabulary (-1)
        for p in self.reachable:
            self.size[self.id_of[p]] = len(p)
            self.trie.add_word(p, (len(p) - 1, self.id_of[p]))
        self.trie.make_automaton()
        self.single = _Single({p: self.id_of[p] for p in self.reachable if len(p) == 1})
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}                  # pieces met again, and pieces met once
        self.fresh: dict[str, bytes] = {}
        self.pieces_of = np.array([p.replace(SPACE, " ") if i not in self.silent else ""
                                   for i, p in enumerate(self.surface)], object)
        self.is_byte = np.zeros(len(self.surface), bool)
        self.is_byte[list(self.byte_of)] = True

    def merge(self, text: str) -> list[str]:
        """The merge rule itself on a short string: best score first, leftmost first."""
        parts = list(text)
        get, none = self.score.get, float("-inf")
        gain = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while gain:
            best = max(gain)
            if best == none:
                break
            at = gain.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del gain[at]
            if at:
                gain[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(gain):
                gain[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging two tokens' characters from scratch gives the two tokens back."""
        if len(self.pairs) >= 2 * CACHE_ITEMS:
            self.pairs.clear()
        a, b = (self.surface[i] if i >= 0 else "" for i in (left, right))
        ok = left < 0 or right < 0 or (a + b not in self.reachable and self.merge(a + b) == [a, b])
        self.pairs[left << 20 | right] = ok
        return ok

    def _next_shorter(self, token: int) -> int:
        """Longest reachable vocabulary entry that is a proper prefix of a token (-2 if none)."""
        got = -2
        text = self.surface[token] if token >= 0 else ""
        for k in range(len(text) - 1, 0, -1):
            if k == 1 or text[:k] in self.reachable:
                got = self.single.get(text[0], -1) if k == 1 else self.id_of[text[:k]]
                break
        self.shorter[token] = got
        return got

    def tokens(self, text: str) -> list[int]:
        """Ids of a text without the begin and end marks (-1: a character outside the vocabulary)."""
        n = len(text)
        if not n:
            return []
        size, shorter, pairs = self.size, self.shorter.get, self.pairs.get
        longest = list(map(self.single.__getitem__, text))     # one character is always a match
        for end, (back, i) in self.trie.iter(text):       # ends ascend: the last match from a place is the longest
            longest[end - back] = i
        failed = 0                                        # bitfield of places without a continuation
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + size[token]
            if not failed >> end & 1:
                ok = pairs(last << 20 | token)
                if ok is None:
                    ok = self.compatible(last, token)
                if ok:
                    out.append(token)
                    if end == n:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            tried = token
            token = shorter(tried)
            if token is None:
                token = self._next_shorter(tried)
            while token == -2:
                failed |= 1 << at
                gone = out.pop()
                at -= size[gone]
                last = out[-1] if out else -1
                token = shorter(gone)
                if token is None:
                    token = self._next_shorter(gone)

    def _piece_ids(self, piece: str) -> bytes:
        ids = self.tokens(piece)
        if -1 in ids:
            at, full = 0, []
            for i in ids:
                full += [i] if i >= 0 else [self.byte_id[b] for b in piece[at].encode("utf-8", "surrogatepass")]
                at += self.size[i]
            ids = full
        return _packed(ids)

    def _new_piece(self, piece: str) -> bytes:
        """Ids of a piece that is not kept; a piece met again is kept, so that the many rare ones don't push out the common."""
        ids = self.fresh.pop(piece, None)
        if ids is not None:
            if len(self.kept) >= CACHE_ITEMS // 2:
                self.kept.clear()
            self.kept[piece] = ids
            return ids
        ids = self._piece_ids(piece)
        if len(piece) <= 64:
            if len(self.fresh) >= CACHE_ITEMS // 2:
                self.fresh.clear()
            self.fresh[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids with begin and end marks, as little-endian unsigned 32-bit integers."""
        got: list[bytes] = []
        if text:
            pieces = self.cut.findall((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE))
            got = list(map(self.kept.get, pieces))
            if None in got:
                for i, ids in enumerate(got):
                    if ids is None:
                        got[i] = self._new_piece(pieces[i])
        return b"".join([_packed([self.bos]), *got, _packed([self.eos])])

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, runs of byte tokens read as UTF-8, marks left out, the added first space dropped."""
        byte = self.is_byte[ids]
        parts = self.pieces_of[ids]
        if byte.any():
            edge = np.flatnonzero(np.diff(byte, prepend=False, append=False)).reshape(-1, 2)
            parts = parts.copy()
            for a, b in edge.tolist():
                parts[a] = bytes(self.byte_of[i] for i in ids[a:b].tolist()).decode("utf-8", "replace")
                parts[a + 1:b] = ""
        text = "".join(parts.tolist())
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


_CODECS: dict[str, PieceCodec] = {}


def _codec(key: str, blob: bytes) -> PieceCodec:
    if key not in _CODECS:
        _CODECS[key] = PieceCodec("", blob)
    return _CODECS[key]


def encode_documents(docs: DataFrame, model_file: str, text_col: str = "text",
                     out: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """All columns of ``docs`` plus ``piece_ids`` (array of int) and ``piece_text`` (their decoding),
    or only digests of both if ``out`` is ("digests",): ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The vocabulary file (half a megabyte) is read on the driver and broadcast.
    """
    with open(model_file, "rb") as f:
        blob = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(blob)
    key = hashlib.sha256(blob).hexdigest()
    digests = "digests" in out
    kind = "n long, ids string, decoded string" if digests else "n long, ids array<int>, decoded string"

    @F.pandas_udf(kind)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(key, sent.value)
        for texts in series:
            rows = []
            for t in texts:
                raw = codec.encode(t or "")
                ids = np.frombuffer(raw, "<u4")
                text = codec.decode(ids)
                if digests:
                    rows.append((len(ids), hashlib.sha256(raw).hexdigest(),
                                 hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
                else:
                    rows.append((len(ids), ids.astype(np.int32), text))
            yield pd.DataFrame(rows, columns=["n", "ids", "decoded"])

    names = ("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("n_tokens", "piece_ids", "piece_text")
    made = docs.withColumn("_pieces", run(F.col(text_col)))
    taken = [c for c in docs.columns if c not in names]
    return made.select(*taken, *[F.col(f"_pieces.{c}").alias(n)
                                 for c, n in zip(("n", "ids", "decoded"), names, strict=True)])
