"""Token ids from a ``tokenizers`` file, each distinct word encoded once per worker.

The library spends tens of microseconds on a word; texts repeat their words. For the two kinds of
file below, splitting at single blanks and line feeds never changes the library's result, so a
worker keeps the ids of the words it has met (bounded) and asks the library
only for new ones, many at a time. Other kinds, texts with other white space, and texts that hold
the string of an added token go to the library as they are.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import held, worker_threads_off

#: Words that a worker knows at most, in two generations: what the last one met outlives it.
KEPT_WORDS = 1_200_000
#: Bytes of texts whose words are told apart together, about.
BYTES_AT_ONCE = 4 << 20
_SAFE_BREAK = re.compile(r"(?<=\S)([ \n])(?=\S)")
_ID = np.dtype("<u4")
#: What may stand behind a word's letters and is a part of its own, whole; an apostrophe may not be.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte-level files write a byte that isn't a printable Latin-1 character as one from U+0100 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTES = {b: chr(256 + k) for k, b in enumerate(_HIDDEN)}


class Encoder:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        worker_threads_off()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.kind = _kind(spec)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.merges = _Merges(spec["model"], self._merged) if self.kind != "other" and _Merges.fit(spec["model"]) else None
        self.known: dict[str, bytes | bool] = {}
        self.older: dict[str, bytes | bool] = {}
        if self.kind == "blank":
            self.feed = self._whole(["a\nb"])[0][4:-4]
            self.mark = np.zeros(self.library.get_vocab_size(), dtype=bool)
            self.mark[[i for w, i in self.library.get_vocab().items() if w.startswith("\u0120")]] = True  # a blank's byte
        elif self.kind == "dropped":
            self.mark = np.zeros(self.library.get_vocab_size(), dtype=bool)
            self.mark[[i for w, i in self.library.get_vocab().items() if w.endswith(self.library.model.end_of_word_suffix)]] = True

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        return [x for _, ids in self.parts(texts) for x in ids]

    def parts(self, texts: list[str] | pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """The ids of texts that lie side by side, of about BYTES_AT_ONCE bytes, and the place of the
        first. Words are split, told apart and put back by Arrow; only distinct ones become
        Python's strings."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        upto, i = np.cumsum(pc.binary_length(texts).to_numpy()), 0
        while i < len(texts):
            end = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + BYTES_AT_ONCE, "right")))
            some = texts.slice(i, end - i)
            yield i, self._whole(some.to_pylist()) if self.kind == "other" else self._some(some)
            i = end
            pa.default_memory_pool().release_unused()  # or each worker keeps what its largest part took

    def _some(self, texts: pa.LargeStringArray) -> list[bytes]:
        if len(self.known) > KEPT_WORDS // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        flat, first = self._words(texts)
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(known.get, words))
        new, odd = {}, []
        for i in [i for i, x in enumerate(found) if not x]:
            if (x := found[i]) is None:
                w = words[i]
                if (x := older.get(w)) is None:
                    new[w] = i
                    continue
                found[i] = known[w] = x
            if x is False:
                found[i] = b""
                odd.append(i)
        if new:
            got = self._learn(set(new))
            known.update(got)
            for w, x in got.items():
                found[i := new[w]] = x or b""
                if x is False:
                    odd.append(i)
        cells = pa.array(found, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(cells.buffers()[1], dtype=np.int64)[first].tolist()
        data = memoryview(cells.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]
        loose = self._holds(texts, ["\0"]) if self.kind == "blank" else np.zeros(len(texts), dtype=bool)
        if odd:  # words with white space at an end, where a break is not safe
            bad = np.zeros(len(words), dtype=bool)
            bad[odd] = True
            loose[np.searchsorted(first, np.flatnonzero(bad[coded.indices.to_numpy()]), "right") - 1] = True
        for i in np.flatnonzero(loose):
            text = texts[i].as_py()
            out[i] = self._pieces(text) if text else b""
        if whole := np.flatnonzero(self._holds(texts, self.added)).tolist():
            for i, x in zip(whole, self._whole([texts[i].as_py() for i in whole])):
                out[i] = x
        return out

    def _holds(self, texts: pa.LargeStringArray, strings: list[str]) -> np.ndarray:
        """Whether each text holds one of ``strings``."""
        held = np.zeros(len(texts), dtype=bool)
        for x in strings:
            held |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        return held

    def _words(self, texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """Words of all texts as keys of ``known``, and where each text's begin; after a blank a
        word carries the blank, in the kind where that matters."""
        if self.kind == "dropped":
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            split = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
            split = pc.split_pattern(split, "\0")
        first = split.offsets.to_numpy().astype(np.int64)
        return split.flatten(), first - first[0]

    def _learn(self, new: set[str]) -> dict[str, bytes | bool]:
        """The ids of ``new``; False where the word must not stand alone."""
        got: dict[str, bytes | bool] = {}
        if self.kind == "blank":
            odd = [w for w in new if not w or w[-1].isspace() or w[:1].isspace() and (w[0] != " " or w[1].isspace())]
            got.update(dict.fromkeys(odd, False))
            if "\n" in got:
                got["\n"] = self.feed
            new.difference_update(odd)
        elif "" in new:
            got[""] = b""
            new.remove("")
        got.update(self._joined(list(new)))
        return got

    def _joined(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, many words to a call. In the kind ``blank`` a word begins with an
        id that begins with a blank, and no other id does; in the other kind, ids that end a part
        of a word are counted."""
        out = self._plain(words)
        words = [w for w in words if w not in out]
        if self.kind == "blank":
            sure, alone, glue = [w for w in words if w[0] == " "], [w for w in words if w[0] != " "], ""
            parts = [1] * len(sure)
        else:
            parts = [1 if w.isalpha() else 2 if w[:-1].isalpha() and w[-1] in ".,;:!?" else 0 for w in words]
            sure, alone, glue = [w for w, n in zip(words, parts) if n], [w for w, n in zip(words, parts) if not n], " "
            parts = [n for n in parts if n]
        out |= zip(alone, self._whole(alone))
        for i in range(0, len(sure), 1024):
            some = sure[i : i + 1024]
            ids = np.array(self.library.encode_batch_fast([glue.join(some)], add_special_tokens=False)[0].ids, dtype=_ID)
            marks, upto = np.flatnonzero(self.mark[ids]), np.cumsum(parts[i : i + 1024])
            if len(marks) != upto[-1]:  # normalising has split a word; no word has fewer marks than counted
                out |= zip(some, self._whole(some))
                continue
            if self.kind == "blank":
                first = (4 * marks).tolist()
                last = [*first[1:], 4 * len(ids)]
            else:
                last = (4 * marks[upto - 1] + 4).tolist()
                first = [0, *last[:-1]]
            data = ids.tobytes()
            out |= zip(some, [data[a:b] for a, b in zip(first, last)])
        return out

    def _plain(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that are Latin letters with at most punctuation behind: their parts are
        known without the library's splitting, so only their merges are to be made."""
        blank, known, ends, out, parts = self.kind == "blank", self.known, {"": b""}, {}, []
        ids: dict[str, bytes] = {}
        for w in words:
            core = w.rstrip(_MARKS)
            bare = core[1:] if blank and core[:1] == " " else core
            if not bare.isalpha() or not bare.isascii() and max(bare) > "\u00ff":
                continue
            end = w[len(core) :]
            if not blank:
                core = core.lower()
            parts.append((w, core, end))
            if core not in ids:
                ids[core] = None if core == w else known.get(core)
            if end not in ends:
                ends[end] = self._whole([end])[0]
        todo = [core for core, got in ids.items() if not got]
        ids.update(zip(todo, self.merges(todo) if self.merges else map(self._merged, todo)))
        for w, core, end in parts:
            out[w] = ids[core] + ends[end]
        return out

    def _merged(self, core: str) -> bytes:
        """The ids of letters, by the library's model alone."""
        text = core.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.library.model.tokenize(text)]).tobytes()

    def _pieces(self, text: str) -> bytes:
        """A text with other white space: broken only between two characters that are not white."""
        if self.kind == "dropped":
            return self._whole([text])[0]
        parts = _SAFE_BREAK.split(text)
        out, words = [], [parts[0]]
        for sep, word in zip(parts[1::2], parts[2::2]):
            words += [" " + word] if sep == " " else ["\n", word]
        alone = [w for w in set(words) if not isinstance(self.known.get(w), bytes)]
        got = dict(zip(alone, self._whole(alone)))
        if "\n" in got:
            got["\n"] = self.feed
        for w in words:
            out.append(got[w] if w in got else self.known[w])
        return b"".join(out)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=_ID).tobytes() for i in range(0, len(texts), 256) for e in self.library.encode_batch(texts[i : i + 256], add_special_tokens=False)]


class _Merges:
    """Byte-pair merges of many words side by side: in each round, every word's first pair of the
    lowest rank becomes one, as in the library, until no word has a pair that merges."""

    NONE, SLOTS, WIDTHS = np.int32(2**31 - 1), 1 << 18, (6, 8, 10, 12, 16, 24, 48)

    @staticmethod
    def fit(model: dict) -> bool:
        suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        usual = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
        return usual and len(model["merges"]) < _Merges.SLOTS // 2 and all(c in vocab and c + suffix in vocab for c in map(_char, range(256)))

    def __init__(self, model: dict, one: Callable[[str], bytes]):
        vocab, suffix, self.one = model["vocab"], model.get("end_of_word_suffix") or "", one
        self.inner = np.array([vocab[_char(b)] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[_char(b) + suffix] for b in range(256)], dtype=np.int32)
        self.base = max(vocab.values()) + 1
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        ranks = {vocab[a] * self.base + vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.keys, self.values = np.full(self.SLOTS, -1), np.full(self.SLOTS, self.NONE)
        slots = self._slots(np.fromiter(ranks, dtype=np.int64, count=len(ranks))).tolist()
        for slot, (key, k) in zip(slots, ranks.items()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % self.SLOTS
            self.keys[slot], self.values[slot] = key, k

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair, its rank; NONE for one that doesn't merge."""
        keys = a.astype(np.int64) * self.base + b
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], self.NONE)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) % self.SLOTS
            there = self.keys[slots[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out

    def __call__(self, words: list[str]) -> list[bytes]:
        """The ids of each word; ``words`` are not empty and hold no zero character."""
        out: list[bytes] = [b""] * len(words)
        if not words:
            return out
        raw = np.frombuffer("\0".join([*words, ""]).encode(), dtype=np.uint8)
        ends = np.flatnonzero(raw == 0)
        begins = np.concatenate(([0], ends[:-1] + 1))
        size, low = ends - begins, 0
        for width in self.WIDTHS:
            at = np.flatnonzero((size > low) & (size <= width))
            for k in range(0, len(at), 8192):
                some = at[k : k + 8192]
                ids = self._some(raw, begins[some], size[some], width)
                data, stop = ids[ids >= 0].astype(_ID).tobytes(), (4 * np.cumsum((ids >= 0).sum(axis=1))).tolist()
                for i, a, b in zip(some.tolist(), [0, *stop], stop):
                    out[i] = data[a:b]
            low = width
        for i in np.flatnonzero(size > low).tolist():
            out[i] = self.one(words[i])
        return out

    def _some(self, raw: np.ndarray, begins: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """The ids of words of at most ``width`` bytes, a row for each, -1 behind the last."""
        n, cols = len(begins), np.arange(width)
        ids = self.inner[raw[np.minimum(begins[:, None] + cols, len(raw) - 1)]]
        ids[cols >= size[:, None]] = -1
        ids[np.arange(n), size - 1] = self.last[raw[begins + size - 1]]
        ranks = np.full((n, width - 1), self.NONE)
        pairs = ids[:, 1:] >= 0
        ranks[pairs] = self._ranks(ids[:, :-1][pairs], ids[:, 1:][pairs])
        out, rows, place = np.empty_like(ids), np.arange(n), np.arange(n)
        while len(ids):
            first = ranks.argmin(axis=1)
            best = ranks[rows, first]
            live = best < self.NONE
            if not live.all():
                out[place[~live]] = ids[~live]
                ids, ranks, place, first, best = ids[live], ranks[live], place[live], first[live], best[live]
                rows = np.arange(len(ids))
                if not len(ids):
                    break
            behind = cols[:-1] > first[:, None]
            ids[rows, first] = self.made[best]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = self.NONE
            ranks[rows, first] = self.NONE
            here, after = ids[rows, first], ids[rows, first + 1]
            on = np.flatnonzero(after >= 0)
            ranks[on, first[on]] = self._ranks(here[on], after[on])
            on = np.flatnonzero(first > 0)
            ranks[on, first[on] - 1] = self._ranks(ids[on, first[on] - 1], here[on])
        return out


def _char(b: int) -> str:
    """How a byte-level file writes a byte."""
    return _BYTES.get(b, chr(b))


def _kind(spec: dict) -> str:
    """blank: byte-level words that carry the blank before them; dropped: white space is dropped
    and only splits; other: anything else."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(norm and x["normalized"] or re.search(r"\s", x["content"]) for x in spec.get("added_tokens") or []):
        return "other"  # the string in a text doesn't tell, or words side by side may make one
    if spec["model"]["type"] != "BPE" or spec.get("post_processor") and spec["post_processor"]["type"] != "ByteLevel":
        return "other"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "blank"
    steps = [(x["type"], x.get("content")) for x in (norm or {}).get("normalizers", [])]
    split = (pre.get("pretokenizers") or [{}])[0]
    if steps == [
        ("NFC", None), ("Replace", " "), ("Lowercase", None)
    ] and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and spec["model"]["end_of_word_suffix"]:
        return "dropped"
    return "other"


def encoder(path: str) -> Encoder:
    """One in a worker process; what it knows outlives the task."""
    return held(f"encoder {path}", lambda: Encoder(path))
