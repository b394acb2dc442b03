import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventide.llm import bpe, registry

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read())


def ids(raw):
    return [int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)]


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_whole_table_against_the_library(spark, real, library):
    got = registry.op12_bpe(spark, SF)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == len(real[1])
    for i, text, _ in real[1]:
        ids, decoded = expected(library, text)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


TRICKY = ["Hello <|startoftext|>World's<|endoftext|>  ÉTÉ", "<|startoftext|", "<|endoftext|><|endoftext|>", "don't I'LL we'Re ''s 's's",
          "é ́x á̧ ﬁ ① Ⅷ ½ İstanbul ΑΣ Σ ß", "\x00\x01 \x1c\x1d\x85\xa0 　x​y", "日本語 テスト 한국어 각", "😀👩‍👩‍👧 🇫🇷",
          "a" * 255, "a" * 256, "a" * 257, "ab" * 3000, "x1y22z333", "__init__ == !!! ...", "\n\r\t", "﻿x �"]


def test_tricky_and_odd_rows(make_docs, odd, library):
    docs = odd + [(200 + i, t) for i, t in enumerate(TRICKY)]
    enc = bpe.encode(make_docs(docs, clash=True), PATH)
    got = bpe.decode(enc, PATH).collect()
    want = [(i, *expected(library, t)) for i, t in docs]
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=repr) == sorted(want, key=repr)


def test_random_strings(codec, library):
    rng = random.Random(4)
    letters = ["the", "ing", "a", "b", "e", "n", "é", "ß", "7", "'", "s", "-", "中", " ", "\n", "😀", "̈", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        assert ids(codec.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_every_space_and_separator_splits_as_in_the_library(codec, library):
    import unicodedata
    marks = [chr(c) for c in range(0x3100) if chr(c).isspace() or unicodedata.category(chr(c)) in ("Cc", "Cf", "Zs", "Zl", "Zp")]
    assert len(marks) > 80
    for m in marks:
        for text in (f"Été{m}b1", f"a{m}\u0301b {m}", f"{m}x{m}{m}é", f"'s{m}'s"):
            assert ids(codec.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids, hex(ord(m))


def test_every_latin_letter_and_case(codec, library):
    for c in [*range(0x20, 0x300), *range(0x2000, 0x2070), 0x20AC, 0x370, 0x3A3, 0x1E9E, 0x1F88, 0x212A, 0xFB01]:
        for text in (f"a{chr(c)}b", f"{chr(c)}", f"X{chr(c)}{chr(c)}1'{chr(c)}S", f"{chr(c)}\u0301z"):
            assert ids(codec.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_heap_and_rank_array_agree(codec, library, monkeypatch):
    rng = random.Random(5)
    ws = ["".join(rng.choices("aeinrst", k=rng.randint(1, 60))) for _ in range(600)] + ["a" * 64, "ab" * 32, "a", ""][:-1]
    want = [tuple(library.encode(w, add_special_tokens=False).ids) for w in ws]
    monkeypatch.setattr(bpe, "ROWS", 50)
    assert [tuple(ids(x)) for x in codec.merged(ws)] == want
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [tuple(ids(x)) for x in codec.merged(ws)] == want


def test_pairs_are_found_and_others_are_not(codec):
    import numpy as np
    keys = np.array(list(codec.ranks), np.int64)
    assert (codec.pairs.find(keys) == np.array(list(codec.ranks.values()))).all()
    rng = np.random.default_rng(1)
    some = rng.integers(0, 1 << 32, 200_000)
    want = np.array([codec.ranks.get(int(k), bpe.NEVER) for k in some])
    assert (codec.pairs.find(some) == want).all()


def test_windows_of_a_long_text(codec, library, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choices(["word", "é", "é", " ", "\n", "\t ", "'s", "<|endoftext|>", "Σ"], k=4000))
    want = library.encode(text, add_special_tokens=False).ids
    for size in (1, 7, 100):
        monkeypatch.setattr(bpe, "WINDOW", size)
        assert ids(codec.encode([text])[0]) == want


def test_caches_stay_bounded_and_right(library, monkeypatch):
    with open(PATH, "rb") as f:
        codec = bpe.Codec(f.read())
    monkeypatch.setattr(bpe, "CACHED", 5)
    monkeypatch.setattr(bpe, "WINDOW", 30)
    texts = [" ".join(f"word{(i * k) % 17}" for i in range(60)) for k in range(5)]
    assert [ids(x) for x in codec.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(len(x) for c in (codec.words, codec.spellings, codec.chunks) for x in (c.young, c.old)) <= 5


def test_empty_table_string_ids_and_unknown_ids(spark, make_docs):
    assert bpe.decode(bpe.encode(make_docs([]), PATH), PATH).collect() == []
    got = bpe.encode(spark.createDataFrame([("x", "hello")], "doc_id string, text string"), PATH).collect()
    assert [(r.doc_id, r.ids) for r in got] == [("x", [3306])]
    ids = spark.createDataFrame([(1, [3306, 10**6, 1002]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(ids, PATH).orderBy("doc_id").collect()] == ["hello</w> world</w>", "", ""]


def test_other_vocabularies_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f, pytest.raises(ValueError):
        bpe.Codec(f.read())


def test_settled_text_is_split_here(codec):
    assert codec.settled  # else all text would go through the library
    kinds = [k for k, _ in codec.segments("Été, l’été—“x” 1½")] + [k for k, _ in codec.segments("日本")] + [k for k, _ in codec.segments("a\x1fb")]
    assert kinds == ["words", "chunks", "chunks"]
