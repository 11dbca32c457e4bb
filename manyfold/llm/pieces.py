"""SentencePiece encoding by a batched numpy Viterbi, and decoding.

A piece carries its blank in front, so a text falls apart before every run of blanks; words of equal
length advance together, character by character. For each end, the hashes of all substrings that end
there come from prefix hashes and probe the sorted hashes of the pieces (a bitmap keeps most probes
away); a vectorised maximum over the starts stores the backpointer. Of equal scores the longer last
piece wins. A character without a piece of its own becomes its UTF-8 bytes' pieces.

The score depends on the model. A unigram model's is the sum of the pieces' scores. A BPE model's
ids are those that merging the best pair first gives, and that isn't the best sum. But a sequence of
pieces is that result exactly if no two neighbours would have merged across their border, which the
merges inside the two decide. So a piece scores only if it may follow the piece that the best path
to its start ends with, and every path that survives is what the library gives.

A long word without blanks is cut first. Where no piece holds two neighbouring characters, no piece
and no merge crosses, so the parts stand alone. What is still longer than WINDOW is, for a BPE
model, encoded in windows that overlap and advance together; two windows are joined at a place where
both have a border and whose neighbours may follow each other, which by the rule above gives the
library's ids. Windows without such a place are encoded as one.

A worker keeps the ids of words it has met, in two generations of bounded bytes, as a corpus repeats
its words; whether pieces may follow each other is kept in a table of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pyspark.sql import types as T

from ._common import held, quoted, ship, text_of, with_batch_column, worker_threads_off
from ._words import chunks, mix

BLANK = "▁"
#: Bytes of the words that a worker keeps, about, and what a word costs beside its characters and ids.
KEPT_BYTES, WORD_BYTES = 128 << 20, 200
#: Characters of a window of a long word, and how far windows overlap.
WINDOW, OVERLAP = 256, 64
#: Characters that advance together at most, and words that are looked for at once.
VITERBI_CHARS, WORDS_AT_ONCE = 200_000, 400_000
_MEMO_BITS = 20
#: Characters of the texts that a worker turns into one batch, about.
BATCH_CHARS = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_FILTER_BITS = 20
_RUN = re.compile(r" *[^ ]+| +")
#: How much less than the lowest score a character without a piece scores.
PENALTY = 10.0


class Pieces:
    """The pieces of a model file: ids(texts) and texts(ids)."""

    def __init__(self, path: str):
        worker_threads_off()
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.surface, self.byte_ids = _surfaces(m), [m.unk_id()] * 256
        hashes, ids, scores, lengths, names, raw = [], [], [], [], [], []
        for i in range(n):
            p = m.id_to_piece(i)
            if m.is_control(i) or m.is_unknown(i):
                continue
            if m.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                continue
            if BLANK in p.lstrip(BLANK):  # a text falls apart before each run of blanks
                continue
            names.append(p)
            codes = np.array([[ord(c) for c in p]], dtype=np.uint64)
            prefix = _prefix(codes)
            raw.append(prefix[0, -1])
            hashes.append(_keys(prefix, len(p), np.array([len(p)]))[0, 0])
            ids.append(i)
            scores.append(m.get_score(i))
            lengths.append(len(p))
        order = np.argsort(np.array(hashes, dtype=np.uint64))
        self.keys = np.array(hashes, dtype=np.uint64)[order]
        assert len(np.unique(self.keys)) == len(self.keys)
        self.ids_of, self.scores = np.array(ids)[order], np.array(scores, dtype=np.float64)[order]
        self.longest = max(lengths, default=1)
        self.unknown = self.scores.min(initial=0.0) - PENALTY
        top = (self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << _FILTER_BITS) + 1)).astype(np.int32)
        self.crowd = int(np.diff(self.first).max(initial=0))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.spanned = np.unique(np.array([a << 21 | b for p in names for a, b in zip(map(ord, p), map(ord, p[1:]))], dtype=np.int64))
        self.memo = np.full(1 << _MEMO_BITS, -1, dtype=np.int64)
        self.raw, self.length = np.array(raw, dtype=np.uint64)[order], np.array(lengths, dtype=np.int64)[order]
        self.powers = _powers(int(2 * self.longest))
        self.bpe = _model_type(open(path, "rb").read()) == 2
        if self.bpe:
            self._merge_trees([names[k] for k in order])

    def _merge_trees(self, names: list[str]) -> None:
        """How each piece comes about: the two pieces merged last, and the level down to which
        merging must have gone by then. Pieces that merging never makes are no candidates."""
        at = {p: k for k, p in enumerate(names)}
        score = self.scores.tolist()
        n = len(names)
        self.left, self.right, self.level, self.made = np.full(n, -1), np.full(n, -1), np.full(n, np.inf), np.zeros(n, dtype=bool)
        for k in sorted(range(n), key=lambda k: len(names[k])):
            parts = list(names[k])
            while len(parts) > 1:
                found = [(score[m], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (m := at.get(a + b)) is not None]
                if not found:
                    break
                i = -max(found)[1]
                pair = parts[i], parts[i + 1]
                parts[i : i + 2] = [pair[0] + pair[1]]
            self.made[k] = len(parts) == 1
            if len(parts) == 1 and len(names[k]) > 1:
                a, b = at[pair[0]], at[pair[1]]
                self.left[k], self.right[k], self.level[k] = a, b, min(score[k], self.level[a], self.level[b])

    def _probe(self, key: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1. The sorted keys are indexed by their leading bits, so a
        probe looks at the few keys that share them, most often none."""
        out = np.full(len(key), -1, dtype=np.int64)
        top = (key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
        place, end = self.first[top], self.first[top + 1]
        at = np.flatnonzero(place < end)
        place, end, key = place[at], end[at], key[at]
        for _ in range(self.crowd):
            hit = self.keys[place] == key
            out[at[hit]] = place[hit]
            place = place + 1
            on = ~hit & (place < end)
            if not on.any():
                break
            at, place, end, key = at[on], place[on], end[on], key[on]
        return out

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``may_follow``, with the pairs met before looked up in a table, where later pairs
        replace earlier ones."""
        code = (a * len(self.keys) + b) * 2
        slot = (mix(code.view(np.uint64)) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
        held = self.memo[slot]
        ok = (held & 1).astype(bool) | (a < 0) | (b < 0)
        new = np.flatnonzero((held >> 1 != code >> 1) & (a >= 0) & (b >= 0))
        if len(new):
            distinct, which = np.unique(code[new], return_inverse=True)
            at = new[np.unique(which, return_index=True)[1]]
            got = self.may_follow(a[at], b[at])
            self.memo[slot[at]] = distinct + got
            ok[new] = got[which]
        return ok

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of pieces a and b leaves a and b. -1: a character without piece.

        The merges are undone, latest first. While the border has a pair whose merge is a piece, that
        merge must come after the ones that take the pair's two sides away; of equal scores the left
        one comes first."""
        ok = np.ones(len(a), dtype=bool)
        on = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[on], b[on]
        took_a, took_b = np.full(len(a), -np.inf), np.full(len(a), -np.inf)
        while len(on):
            with np.errstate(over="ignore"):
                n = self.length[a] + self.length[b]
                key = mix(self.raw[a] * self.powers[self.length[b]] + self.raw[b] + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            c = self._probe(key)
            s = np.where(c >= 0, self.scores[c], -np.inf)
            bad = (c >= 0) & (s > took_a) & (s >= took_b)
            ok[on[bad]] = False
            going = ~bad & ((self.left[a] >= 0) | (self.left[b] >= 0))
            on, a, b, took_a, took_b = on[going], a[going], b[going], took_a[going], took_b[going]
            from_b = (self.left[b] >= 0) & ((self.left[a] < 0) | (self.level[b] <= self.level[a]))
            took_b, took_a = np.where(from_b, self.level[b], took_b), np.where(from_b, took_a, self.level[a])
            a, b = np.where(from_b, a, self.right[a]), np.where(from_b, self.left[b], b)
        return ok

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of one length: for each place in a word, the length of the piece that the best
        path ends there with (0 where it has no border) and that piece (-1: a character without)."""
        n, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(n, length).astype(np.uint64)
        prefix = _prefix(codes)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        size, last = np.zeros((n, length + 1), dtype=np.int32), np.full((n, length + 1), -1, dtype=np.int32)
        every = np.arange(n)
        for end in range(1, length + 1):
            span = np.arange(min(self.longest, end), 0, -1)  # longest first: argmax takes the first of equals
            found = self._probe(_keys(prefix, end, span).ravel())
            at = np.flatnonzero(found >= 0)
            found = found[at]
            if self.bpe:
                made = self.made[found]
                at, found = at[made], found[made]
                fits = self.follows(last[at // len(span), end - span[at % len(span)]].astype(np.int64), found)
                at, found = at[fits], found[fits]
            row, k = at // len(span), at % len(span)
            score = np.full((n, len(span)), -np.inf)
            score[row, k] = best[row, end - span[k]] + self.scores[found]
            which = np.full((n, len(span)), -1, dtype=np.int32)
            which[row, k] = found
            alone = ~np.isfinite(score).any(axis=1) if self.bpe else which[:, -1] < 0
            score[alone, -1] = best[alone, end - 1] + self.unknown
            top = score.argmax(axis=1)
            last[:, end] = which[every, top]
            best[:, end], size[:, end] = score[every, top], span[top]
        border, at = np.zeros((n, length + 1), dtype=bool), np.full(n, length)
        while (at > 0).any():
            on = np.flatnonzero(at > 0)
            border[on, at[on]] = True
            at[on] -= size[on, at[on]]
        return np.where(border, size, 0)[:, 1:], last[:, 1:]

    def viterbi(self, words: list[str]) -> list[bytes]:
        """The ids of words (blanks written as BLANK), all of one length."""
        size, last = self.paths(words)
        real = size > 0
        got, counts = last[real], real.sum(axis=1)
        ends = np.cumsum(counts).tolist()
        data = np.where(got >= 0, self.ids_of[got], 0).astype("<u4").tobytes()
        out = [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
        for k in np.flatnonzero((real & (last < 0)).any(axis=1)).tolist():
            at = np.flatnonzero(real[k])
            out[k] = self._spelled(words[k], at, last[k, at])
        return out

    def _spelled(self, word: str, ends: np.ndarray, found: np.ndarray) -> bytes:
        """The ids of pieces that end behind the places ``ends``, characters without one by bytes."""
        got: list[int] = []
        for i, p in zip(ends.tolist(), found.tolist()):
            got += [int(self.ids_of[p])] if p >= 0 else [self.byte_ids[b] for b in word[i].encode("utf-8", "replace")]
        return np.array(got, dtype="<u4").tobytes()

    def _long(self, word: str) -> bytes:
        """The ids of a word of more than WINDOW characters."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        two = codes[:-1] << 21 | codes[1:]
        found = np.minimum(np.searchsorted(self.spanned, two), max(0, len(self.spanned) - 1))
        cuts = np.flatnonzero(self.spanned[found] != two) + 1 if len(self.spanned) else np.arange(1, len(word))
        ends = [*cuts.tolist(), len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends], ends)]
        out, by_length = {}, {}
        for p in set(parts):
            if len(p) <= WINDOW or not self.bpe:
                by_length.setdefault(len(p), []).append(p)
            else:
                out[p] = self._windows(p)
        for length, some in by_length.items():
            step = max(1, VITERBI_CHARS // length)
            for i in range(0, len(some), step):
                out |= zip(some[i : i + step], self.viterbi(some[i : i + step]))
        return b"".join(out[p] for p in parts)

    def _windows(self, word: str) -> bytes:
        """The ids of a word from windows that overlap. Where the pieces repeat with a period, borders
        may never meet; then windows begin at every place that a border must fall on. A word that
        can't be joined so either advances alone."""
        for variants in (1, self.longest):
            if (found := self._joined(word, variants)) is not None:
                return self._spelled(word, *found)
        size, last = self.paths([word])
        return self._spelled(word, np.flatnonzero(size[0]), last[0][size[0] > 0])

    def _joined(self, word: str, variants: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(last character, piece) of a word's pieces; None if two windows have no place in common."""
        bases = range(WINDOW - OVERLAP, len(word) - OVERLAP, WINDOW - OVERLAP)
        by_length: dict[int, set[str]] = {}
        for a in (0, *(b + j for b in bases for j in range(variants))):
            by_length.setdefault(min(WINDOW, len(word) - a), set()).add(word[a : a + WINDOW])
        found = {}
        for length, distinct in by_length.items():
            some = list(distinct)
            for i in range(0, len(some), VITERBI_CHARS // WINDOW):
                part = some[i : i + VITERBI_CHARS // WINDOW]
                for w, s, p in zip(part, *self.paths(part)):
                    found[w] = np.concatenate(([0], np.flatnonzero(s) + 1)), p[s > 0].astype(np.int64)
        ends, got = found[word[:WINDOW]]
        out, ends = [], ends[1:]
        for a in bases:
            for j in range(a, a + variants):
                e, p = found[word[j : j + WINDOW]]
                both = np.intersect1d(ends[:-1], e[:-1] + j)
                both = both[np.argsort(np.abs(both - (a + OVERLAP // 2)), kind="stable")]
                i, k = np.searchsorted(ends, both), np.searchsorted(e, both - j)
                fit = np.flatnonzero(self.follows(got[i], p[k]))
                if len(fit):
                    i, k = int(i[fit[0]]), int(k[fit[0]])
                    out.append((ends[: i + 1], got[: i + 1]))
                    ends, got = e[k + 1 :] + j, p[k:]
                    break
            else:
                return None
        out.append((ends, got))
        return np.concatenate([x for x, _ in out]) - 1, np.concatenate([x for _, x in out])

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit bytes; an empty text has none."""
        out, split, words = [], [], 0
        for text in texts:
            split.append(self._words(text))
            words += len(split[-1])
            if words >= WORDS_AT_ONCE:
                out += self._ids_of_words(split)
                split, words = [], 0
        return out + self._ids_of_words(split)

    def _ids_of_words(self, split: list[list[str]]) -> list[bytes]:
        if self.held > KEPT_BYTES // 2:
            self.known, self.older, self.held = {}, self.known, 0
        known, older, by_length = self.known, self.older, {}
        for w in set().union(*split).difference(known):
            if (ids := older.get(w)) is not None:
                self._keep(w, ids)
            elif len(w) > WINDOW:
                self._keep(w, self._long(w.replace(" ", BLANK)))
            else:
                by_length.setdefault(len(w), []).append(w)
        for length, words in by_length.items():
            step = max(1, VITERBI_CHARS // length)
            for i in range(0, len(words), step):
                some = words[i : i + step]
                got = self.viterbi([w.replace(" ", BLANK) for w in some])
                known.update(zip(some, got))
                self.held += (WORD_BYTES + 2 * length) * len(some) + sum(map(len, got))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def _keep(self, word: str, ids: bytes) -> None:
        self.known[word] = ids
        self.held += WORD_BYTES + 2 * len(word) + len(ids)

    def _words(self, text: str) -> list[str]:
        """A text with the blank that is put before it, cut before every run of blanks and around
        line feeds."""
        if not text:
            return []
        out: list[str] = []
        text = " " + text.replace(BLANK, " ")
        runs = "  " in text
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            if runs and "  " in line:
                out += _RUN.findall(line)
                continue
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out += [" " + w for w in rest]
        return out

    def text(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return text_of_ids(self.surface, ids)


def text_of_ids(surface: list[bytes], ids: np.ndarray) -> str:
    out = b"".join(map(surface.__getitem__, ids.tolist()))
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def _surfaces(m: object) -> list[bytes]:
    """What each id stands for in a text."""
    out = []
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        out.append(b"" if m.is_control(i) or m.is_unknown(i) else bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(BLANK, " ").encode())
    return out


@lru_cache(maxsize=2)
def surfaces(path: str) -> list[bytes]:
    """One for each file and worker process, for decoding alone."""
    from sentencepiece import SentencePieceProcessor

    return _surfaces(SentencePieceProcessor(model_file=path))


def _prefix(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of rows of code points, the empty one first."""
    out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * _P + codes[:, j] + np.uint64(1)
    return out


@lru_cache(maxsize=64)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, _P))))


def _model_type(data: bytes) -> int:
    """The model type (1 unigram, 2 BPE) in a model file: field 3 of the trainer's settings, which
    are field 2 of the file."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        i = 0

        def number() -> int:
            nonlocal i
            out = shift = 0
            while True:
                b = data[i]
                i += 1
                out |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return out

        while i < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                n = {1: 8, 5: 4}.get(tag & 7) or number()
                yield tag >> 3, data[i : i + n]
                i += n

    trainer = next((v for k, v in fields(data) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1)


def _keys(prefix: np.ndarray, end: int, span: np.ndarray) -> np.ndarray:
    """Hashes of the substrings of each row that end at ``end`` and have the lengths ``span``."""
    with np.errstate(over="ignore"):
        power = _powers(int(span.max()))[span]
        return mix(prefix[:, end][:, None] - prefix[:, end - span] * power[None, :] + span.astype(np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F))


def pieces(path: str) -> Pieces:
    """One in a worker process; what it knows outlives the task."""
    return held(f"pieces {path}", lambda: Pieces(path))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, text, ids (little-endian unsigned 32-bit bytes) of each row, and, if asked for, decoded,
    the text of these ids, from the same worker. A null text is empty and has no ids. Line order, equal
    and null identifiers and further columns don't matter; an empty table gives an empty result."""
    ship(docs.sparkSession)
    names = ["doc_id", "text", "ids", *(["decoded"] if decoded else [])]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pieces(model)
        for batch in batches:
            for s in chunks(batch.column(1).to_pylist(), BATCH_CHARS):
                part = batch.slice(s.start, s.stop - s.start)
                ids = made.ids(part.column(1).to_pylist())
                new = [pa.array(ids, pa.binary())]
                if decoded:
                    new.append(pa.array([made.text(np.frombuffer(x, dtype="<u4")) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=names)

    kind = "doc_id long, text string, ids binary" + (", decoded string" if decoded else "")
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(f, kind)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with a column ``decoded``, the text of its column ``ids`` (null: of none). A column
    of that name that is there already is replaced. The worker holds the pieces' texts alone."""
    ship(encoded.sparkSession)
    encoded = encoded.select(*(quoted(c) for c in encoded.columns if c != "decoded"))
    at = encoded.columns.index("ids")

    def make() -> Callable[[pa.RecordBatch], pa.Array]:
        surface = surfaces(model)
        return lambda batch: pa.array([text_of_ids(surface, np.frombuffer(x or b"", dtype="<u4")) for x in batch.column(at).to_pylist()], pa.string())

    return with_batch_column(encoded, "decoded", T.StringType(), make)
