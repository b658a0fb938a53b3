"""BPE against the tokenizers library, and exact round trips."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoaudit.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def pair():
    return bpe.Vocabulary(bpe.public_spec()), tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_random_texts_match_the_library(pair):
    own, library = pair
    random.seed(3)
    pool = "ab \n\t\r\x0b\x1c\x85\xa0 　 'streLl0129٣½éß漢!?.,\U0001f600́\x00"
    texts = ["".join(random.choice(pool) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += [t + "<|endoftext|>" + t for t in texts[:200]] + ["<|endoftext|>" * 3, "<|endoftext|", "it's they'll 'S we'd've", "x" * 300]
    ids, counts = own.encode_column(pa.array(texts))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, got, e in zip(texts, parts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == e.ids, repr(text)
        assert own.decode(got.tolist()) == library.decode(e.ids, skip_special_tokens=False) == text


def test_long_pieces_take_the_heap_and_agree(pair):
    own, library = pair
    random.seed(4)
    for text in ["a" * 4000, "abcabd" * 900, "é" * 2000, "".join(random.choice("thear") for _ in range(3000)), "?!" * 500]:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
        raw = text.encode()[: bpe.SCAN_LIMIT]
        assert own.merge_short([raw])[0] == own.merge_long(raw)


def test_forgetting_changes_nothing(pair, monkeypatch):
    own, library = pair
    monkeypatch.setattr(bpe, "CACHE", 50)
    random.seed(5)
    for _ in range(30):
        text = " ".join("".join(random.choice("etaoin") for _ in range(5)) for _ in range(40))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def thue_morse(k):
    """Two words of 2**k letters that collide under every polynomial modulo 2**64, for k of 10 and more."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("k", [6, 10, 11, 12])
def test_words_that_collide_under_polynomials(pair, k):
    a, b = thue_morse(k)
    own = bpe.Vocabulary(bpe.public_spec())
    for text in (a, b, f"{a} {b} {a}"):
        assert own.encode(text) == pair[1].encode(text, add_special_tokens=False).ids


def test_pieces_are_told_apart_when_hashes_collide(pair, monkeypatch):
    own, library = bpe.Vocabulary(bpe.public_spec()), pair[1]
    monkeypatch.setattr(bpe, "span_hashes", lambda data, x, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    random.seed(6)
    for _ in range(5):
        text = " ".join("".join(random.choice("etaoins") for _ in range(random.choice([1, 3, 9, 20, 300]))) for _ in range(60))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_names_with_dots(spark):
    df = spark.createDataFrame([("Hello", "x", 1)], "`a.b` string, `c.d` string, N_TOKENS int")
    got = bpe.digests(df, bpe.public_spec(), "a.b")
    assert got.columns == ["c.d", "n_tokens", "ids_sha256", "decoded_sha256"] and got.first()["n_tokens"] == 1


def test_frames(spark, pair):
    rows = [(1, "Hello world", "x"), (2, None, None), (3, "", "y"), (1, "Hello world", "x"), (None, "éa<|endoftext|>b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.digests(df, bpe.public_spec()).collect()
    assert len(got) == 5
    assert got[0] == got[3]
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in got[1:3]] == [(2, 0, empty, empty), (3, 0, empty, empty)]
    ids = pair[1].encode("Hello world", add_special_tokens=False).ids
    assert got[0].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    both = bpe.decode(bpe.encode(df, bpe.public_spec()), bpe.public_spec())
    assert {(r.text or "", r.decoded) for r in both.collect()} == {(t or "", t or "") for _, t, _ in rows}
    odd = spark.createDataFrame([([99999999, -1],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, bpe.public_spec()).collect()] == ["��", "", ""]
    assert bpe.digests(df.where(F.lit(False)), bpe.public_spec()).count() == 0
