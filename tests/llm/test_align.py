import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from eventide.llm import align, registry

SF = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def tok():
    with open(A, "rb") as f, open(B, "rb") as g:
        return align.Tokenizers(f.read(), g.read())


def encoded(libraries, text):
    """(ids, ends) of A and B, or nothing."""
    a, b = libraries
    if not text:
        return [], [], [], []
    want = (" " + text).encode()
    letters = align.byte_alphabet()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    by_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    by_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(by_a) != want or b"".join(by_b) != want:
        return [], [], [], []
    return ids_a, np.cumsum([len(x) for x in by_a]).tolist(), ids_b, np.cumsum([len(x) for x in by_b]).tolist()


def brute(libraries, docs):
    per, count = [], Counter()
    for i, text in docs:
        ids_a, ends_a, ids_b, ends_b = encoded(libraries, text)
        cuts = sorted(set(ends_a) & set(ends_b))
        links, said, pa_, pb = [], [], 0, 0
        where_a, where_b = ({e: k for k, e in enumerate(x)} for x in (ends_a, ends_b))
        for cut in cuts:
            qa, qb = where_a[cut] + 1, where_b[cut] + 1
            links.append((ids_a[qa - 1], ids_b[qb - 1]))
            said.append(",".join(map(str, ids_a[pa_:qa])) + "|" + ",".join(map(str, ids_b[pb:qb])))
            pa_, pb = qa, qb
        per.append((i, len(ids_a), len(ids_b), len(cuts), links, ";".join(said)))
        count.update(links)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted(((i, na, nb, g, len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls),
                    hashlib.sha256(s.encode()).hexdigest() if s else "") for i, na, nb, g, ls, s in per), key=repr)


def rows(df):
    return sorted((tuple(r[c] for c in RESULT) for r in df.collect()), key=repr)


def test_whole_table_against_brute_force(spark, real, libraries, monkeypatch):
    got = registry.op13_token_align(spark, SF)
    assert {dict(got.dtypes)[c] for c in RESULT[:-1]} == {"bigint"}
    want = brute(libraries, [(i, t) for i, t, _ in real[1]])
    assert rows(got) == want
    monkeypatch.setattr(align, "HEAD", 50)  # most pairs now go through the join
    assert rows(registry.op13_token_align(spark, SF)) == want


TRICKY = ["<|endoftext|> <s> x </s> <unk>", "  two  spaces ", "▁under score▁", "tab\tand\n\nlines \n", "ﬁ ① é é 中文 テスト 😀", " ", "\x00",
          "don't we'll 123456 __init__", "a" * 700, " x　y\xa0z", "x ▁ y"]


def test_tricky_and_odd_rows(make_docs, odd, libraries):
    docs = odd + [(300 + i, t) for i, t in enumerate(TRICKY)]
    got = align.link_report(align.align(make_docs(docs, clash=True), A, B))
    assert rows(got) == brute(libraries, docs)


def test_empty_table_and_string_ids(spark, make_docs):
    assert align.link_report(align.align(make_docs([]), A, B)).collect() == []
    got = align.link_report(align.align(spark.createDataFrame([("x", "hello"), ("y", None)], "doc_id string, text string"), A, B))
    assert {r.doc_id: (r.n_links, r.n_best) for r in got.collect()} == {"x": (1, 1), "y": (0, 0)}


def test_groups_rebuild_the_tokens(make_docs, text_maker, tok):
    text = text_maker(3, 400)
    r = align.align(make_docs([(1, text)]), A, B).first()
    assert r.a_cuts[-1] == len(r.a_ids) and r.b_cuts[-1] == len(r.b_ids) and len(r.a_cuts) == len(r.b_cuts)
    for lo_a, hi_a, lo_b, hi_b in zip([0, *r.a_cuts], r.a_cuts, [0, *r.b_cuts], r.b_cuts):
        assert b"".join(tok.bytes_a[i] for i in r.a_ids[lo_a:hi_a]) == b"".join(tok.bytes_b[i] for i in r.b_ids[lo_b:hi_b])


def test_merge_path_pieces_are_equal_work_and_find_all_common_ends():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (np.array(sorted(rng.sample(range(1, 60), rng.randint(0, 40))), np.int64) for _ in range(2))
        for work in (1, 2, 3, 7, 100):
            cut = align.diagonals(a, b, work)
            d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
            merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
            assert cut.tolist() == [sum(side == 0 for _, side in merged[:k]) for k in d]
            at_a, at_b = align.common_ends(a, b, work)
            assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_windows_of_a_long_text(tok, libraries, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices(["word", "The ", " x1", "  ", "\n", "é", "don't ", "a b c ", "."], k=1500))
    ids_a, _, ids_b, _ = encoded(libraries, text)
    for size in (1, 10, 200):
        monkeypatch.setattr(align, "WINDOW", size)
        a, b = tok.tokens(text)
        assert (a.tolist(), b.tolist()) == (ids_a, ids_b)


def test_digest_in_blocks(make_docs, text_maker, monkeypatch, tok):
    a, b = tok.tokens(text_maker(8, 300))
    at_a, at_b = align.common_ends(np.cumsum(tok.len_a[a]), np.cumsum(tok.len_b[b]))
    table = [x % i for i in range(len(tok.bytes_a)) for x in (b"%d,", b"%d|", b"%d;")]
    args = (a, b, at_a + 1, at_b + 1, np.array([0, len(at_a)]), np.array([0, len(a)]), np.array([0, len(b)]), table)
    whole = align.notation(*args)
    monkeypatch.setattr(align, "NOTED", 5)
    assert align.notation(*args) == whole
