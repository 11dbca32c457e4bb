import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from manyfold.llm import packing, pieces, queries as q, token_files
from manyfold.llm.sharding import jump, shard
from manyfold.llm.tokens import Encoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ENCODERS = {n: Encoder(q.tokenizer_file(n)) for n in FILES}
ODD = st.lists(st.sampled_from(["a", "B", "é", "é", " ", "\n", "  ", "\t", " ", ",", ".", "'s", "İ", "Σ", "日", "😀", "12", "<|endoftext|>", "\0", "word", "Word,"]), max_size=25).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(ODD, st.text(max_size=20)), max_size=4))
def test_cached_ids_are_the_librarys(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for e in ENCODERS.values():
        assert e.ids(texts) == [np.array(x.ids, dtype="<u4").tobytes() for x in e.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_added_tokens_in_texts_are_the_librarys(name):
    fresh = Tokenizer.from_file(q.tokenizer_file(name))
    texts = ["hello <|endoftext|> world", "plain words", "a<|startoftext|>b\nc", "<|ENDOFTEXT|> <|endof text|>", "x  <|endoftext|><|endoftext|>\t", "", "hello <|endoftext|> world"]
    assert ENCODERS[name].kind != "other"
    assert ENCODERS[name].ids(texts) == [np.array(fresh.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def _new_words(n):
    import random

    r = random.Random(8)
    parts = ["the", "ing", "sch", "ción", "é", "ß", "q", "ZZ", "o", "ent", "ÀÿÞ", "a"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 9))) + r.choice(["", "", ",", "###", "?!"]) for _ in range(n)] + ["ab" * 200, "é" * 90]


class _Counted:
    """The library, which counts what its model is asked."""

    def __init__(self, library):
        self.library, self.asked = library, 0

    def __getattr__(self, name):
        return getattr(self.library, name)

    @property
    def model(self):
        counted, model = self, self.library.model

        class Model:
            def tokenize(self, text):
                counted.asked += 1
                return model.tokenize(text)

        return Model()


@pytest.mark.parametrize("name", FILES)
def test_new_words_are_merged_side_by_side(name):
    e, words = Encoder(q.tokenizer_file(name)), _new_words(6000)
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in e.library.encode_batch(words, add_special_tokens=False)]
    e.library = _Counted(e.library)
    assert e.ids(words) == want
    assert e.library.asked < 100  # the library's model takes several times as long, a word at a time


@pytest.mark.parametrize("name", FILES)
def test_small_parts_and_small_memory_give_the_same_ids(name, monkeypatch):
    import pyarrow as pa

    from manyfold.llm import tokens

    words = _new_words(3000)
    texts = [" ".join(words[k : k + 7]) + ["", "\n", "  x", "\0", "<|endoftext|>"][k % 5] for k in range(0, 3000, 5)] + ["", "\n"]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in ENCODERS[name].library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "KEPT_WORDS", 400)
    monkeypatch.setattr(tokens, "BYTES_AT_ONCE", 1000)
    e = Encoder(q.tokenizer_file(name))
    for column in (texts, pa.array(["left out", *texts])[1:]):
        got = list(e.parts(column))
        assert len(got) > 20 and [k for k, _ in got] == np.cumsum([0, *(len(x) for _, x in got)])[:-1].tolist()
        assert [x for _, ids in got for x in ids] == want
    assert len(e.known) < 1000 and len(e.older) < 1000


def test_packing_blocks_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    docs = [(k, rng.zipf(1.3, 1 << 16).clip(0, 50_000).astype("<u4").tobytes()) for k in range(64)]
    tracemalloc.start()
    try:
        image = token_files.write_image(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20  # 16 MB of ids beside it
    assert [(n, i.astype("<u4").tobytes()) for n, i in token_files.read_image(image)] == docs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.sampled_from([50.0, 90.0, 100.0]))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, dtype=np.uint32)
    data, index = token_files.pack_blocks(ids, percentile)
    assert (token_files.unpack_blocks(data, index, len(ids)) == ids).all()


def test_image_round_trip():
    rng = np.random.default_rng(0)
    docs = [(5, b""), (None, rng.integers(0, 50_000, 10).astype("<u4").tobytes()), (-3, rng.zipf(1.3, 3000).clip(0, 2**31).astype("<u4").tobytes())]
    image = token_files.write_image(docs)
    assert [(n, i.astype("<u4").tobytes()) for n, i in token_files.read_image(image)] == docs
    flat = np.frombuffer(b"".join(d for _, d in docs), dtype="<u4")
    for a, b in ((0, 0), (3, 20), (250, 260), (0, 4000), (1000, 1001)):
        assert (token_files.read_range(image, a, b) == flat[a:b]).all()


def _ids(name, text, end):
    return np.array([*ENCODERS[name].library.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


MODEL = q.tokenizer_file("piece_bpe_32k.model")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ODD, st.text("aehint r\n", max_size=30), st.text(max_size=15)), max_size=4))
def test_viterbi_gives_the_librarys_ids(texts):
    import sentencepiece

    global _library
    _library = globals().get("_library") or (sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.pieces(MODEL))
    texts = [t.encode("utf-8", "ignore").decode().replace("\0", "") for t in texts]
    got = [np.frombuffer(x, dtype="<u4") for x in _library[1].ids(texts)]
    assert [x.tolist() for x in got] == _library[0].encode(texts)
    assert [_library[1].text(x) for x in got] == [t.replace(pieces.BLANK, " ") for t in texts]


def test_long_words_give_the_librarys_ids():
    import random
    import time

    import sentencepiece

    r, library, mine = random.Random(4), sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.pieces(MODEL)
    letters = "abcdefghijklmnopqrstuvwxyz"
    make = [lambda n: "".join(r.choice(letters) for _ in range(n)), lambda n: "a" * n, lambda n: ("ab" * n)[:n], lambda n: "=" * n + "-" * n, lambda n: " " * n, lambda n: "".join(r.choice("etaoin") for _ in range(n)), lambda n: "".join(r.choice(["the", "日本", "é", "ing"]) for _ in range(n // 2))]
    texts = [f(n) for f in make for n in (256, 257, 300, 449, 700, 2000)]
    got = mine.ids(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == library.encode(texts)
    began = time.process_time()
    assert np.frombuffer(mine.ids([make[0](20_000)])[0], dtype="<u4").size
    assert time.process_time() - began < 2


def test_words_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_BYTES", 40_000)
    p, fresh = pieces.Pieces(MODEL), pieces.pieces(MODEL)
    texts = [f"one two w{k} x{k * k} three" for k in range(2000)]
    assert [x for i in range(0, 2000, 50) for x in p.ids(texts[i : i + 50])] == fresh.ids(texts)
    assert len(p.known) + len(p.older) < 500


def test_pieces_odd_rows(odd, rows):
    out = [r.asDict() for r in pieces.decode(pieces.encode(odd, MODEL), MODEL).collect()]
    assert sorted(((str(r["doc_id"]), r["decoded"]) for r in out)) == sorted((str(i), t or "") for i, t, *_ in rows)
    assert all((len(r["ids"]) > 0) == (len(r["text"]) > 0) for r in out)
    assert sorted(map(str, out)) == sorted(str(r.asDict()) for r in pieces.encode(odd, MODEL, decoded=True).collect())


def test_token_files_odd_rows(spark, odd, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 30_000)
    at = f"file://{tmp_path}/token files"
    files = token_files.write_token_files(odd, q.tokenizer_file(FILES[1]), at, image_bytes=2000)
    assert files.select("part").distinct().count() > 2 < files.count()
    (tmp_path / "token files/data/part-000000-000000-lost.pfb").write_bytes(b"of an attempt that was lost")
    got = [tuple(r) for r in token_files.read_token_files(spark, at).collect()]
    want = [(i, len(x := _ids(FILES[1], t, 2)), x.tobytes()) for i, t, *_ in rows]
    assert sorted(((a, c, d) for a, _, c, d in got), key=str) == sorted(want, key=str)
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in by_start] == np.cumsum([0, *(r[2] for r in by_start)])[:-1].tolist()
    names = [r[0] for r in by_start]
    assert names == sorted(names, key=lambda i: (i is not None, i))
    with pytest.raises(Exception, match="listing.*exists"):  # what is there is not written over
        token_files.write_token_files(odd, q.tokenizer_file(FILES[1]), at)


def test_token_files_query(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    ids = [_ids(FILES[1], t, 2) for _, t in docs]
    starts = np.cumsum([0, *map(len, ids)])
    want = [(i, a, len(x), zlib.crc32(x.tobytes())) for (i, _), a, x in zip(docs, starts.tolist(), ids)]
    assert sorted(map(tuple, q.op10_token_files(spark, sf_dir).collect())) == want


def test_packing_odd_rows(odd, rows):
    got = [r.asDict() for r in packing.pack(odd, q.tokenizer_file(FILES[0]), length=64).collect()]
    pieces_of, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in sequences.values():
        assert [a for a, _ in sorted(x)] == np.cumsum([0, *(n for _, n in sorted(x))])[:-1].tolist() and sum(n for _, n in x) <= 64
    assert sum(sum(n for _, n in x) < 64 for x in sequences.values()) <= 1  # so few bytes are one partition
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        pieces_of[r["doc_id"]].append(r)
    have, whole, at = [], [], {}
    for i, t, *_ in rows:
        whole.append((str(i), _ids(FILES[0], t, 1).tobytes()))
    for i, ps in pieces_of.items():
        open_: list = []
        for p in ps:
            if p["start"] == 0:
                open_ = []
                have.append((str(i), open_))
            assert p["start"] == sum(map(len, open_)) // 4
            open_.append(p["ids"])
    assert sorted((i, b"".join(x)) for i, x in have) == sorted(whole) and not at


def test_hilbert_curve_walks():
    import itertools

    grid = np.array(list(itertools.product(range(8), repeat=3)))
    key = packing.hilbert_key(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_jump_moves_only_into_the_new_shard():
    keys = np.arange(20_000, dtype=np.uint64)
    a, b = jump(keys, 40), jump(keys, 41)
    assert set(b[a != b]) == {40} and 0.5 < (a != b).sum() / (20_000 / 41) < 1.5
    assert np.bincount(a, minlength=40).min() > 350
    assert (jump(keys, 1) == 0).all()


def _plain_jump(key, shards):
    """Lamping and Veach, 2014, with Python's numbers."""
    at, then = -1, 0
    while then < shards:
        at = then
        key = (key * 2862933555777941757 + 1) % 2**64
        then = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(1, 5000))
def test_jump_against_plain_loops(keys, shards):
    assert jump(np.array(keys, dtype=np.uint64), shards).tolist() == [_plain_jump(k, shards) for k in keys]


def test_sharding_odd_rows(odd, rows):
    got = [r.asDict() for r in shard(odd, 5).collect()]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=str)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    for k in {r["doc_id"] for r in got}:
        assert len({r["shard"] for r in got if r["doc_id"] == k}) == 1


def _written(docs):
    from manyfold.llm._common import own_folder

    at = own_folder(docs.sparkSession, "token-files")
    token_files.write_token_files(docs, q.tokenizer_file(FILES[1]), at)
    return token_files.read_token_files(docs.sparkSession, at)


@pytest.mark.parametrize("f", [lambda d: shard(d), lambda d: packing.pack(d, q.tokenizer_file(FILES[0])), lambda d: _written(d), lambda d: pieces.encode(d, q.tokenizer_file("piece_bpe_32k.model"))])
def test_empty_table(none, f):
    assert f(none).count() == 0
