import random

import pytest

CLASH = "digest run best size key h n part ids score shard slot fp cell node component a b t c w x y p q label words text_sha256 component_id __h __q __x __p __id __toxicity __quality __row __kept _row _kept _toxicity _quality _quality_host _host _path _x _p _site_host _origin a.b a`b".split()


def odd_rows() -> list[tuple]:
    r = random.Random(5)
    words = ["the", "Alpha", "beta,", "gamma.", "déjà", "日本語", "x", "idiot", "don't", "12", "--", "😀"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 40))), "en", f"src{k % 3}") for k in range(30)]
    long = " ".join(f"w{r.randint(0, 5000)}" for _ in range(30_000))
    rows += [(100, None, "en", "src0"), (101, "", None, None), (102, " \n\t ", "en", None), (103, long, "de", "src1"), (104, long + " end", "de", "src1"), (105, "a  b\r\n\x0bc", "en", "src2"), (106, "a b c", "en", "src2"), (107, "abc", "en", "src2"), (108, "<|endoftext|> x y   z", "en", "src2"), (None, "no name", "en", "src0"), (None, None, None, None)]
    rows += [rows[0], rows[0], (7, rows[7][1], "en", "src1"), (109, rows[3][1], "fr", "src0"), (110, "\n" + rows[3][1].replace(" ", "\n") + " ", "fr", "src0"), (111, "one", "en", "src0"), (112, "one two", "en", "src0"), (113, "ONE Two", "en", "src0")]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    rows = odd_rows()
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in CLASH)
    return spark.createDataFrame([(*x, *["clash"] * len(CLASH)) for x in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def rows():
    return odd_rows()
