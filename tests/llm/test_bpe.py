"""Encoding equals the tokenizers library; trees of any leaf size give what merging the whole piece gives."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm.bpe import Codec, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return Codec(PATH)


def texts():
    r = random.Random(5)
    alphabets = ["ab", "abc  \n", "the and tion ing ", "éèçßüñ ", "'sdtrevml ", "日本語テスト ", "0123456789 ,.", " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　", "🙂👍🏽‍ ️", "ǅʰⅣ²½٣ ำ"]
    out = ["", " ", "  ", "\n\n a", "a" * 5000, "ab" * 1500, "<|endoftext|>", "x<|endoftext|> y<|endoftext", "aaa bbb" * 40, "=" * 777, "the" * 900, "\x00\x01\x02"]
    for _ in range(400):
        a = "".join(r.sample(alphabets, r.randint(1, 3)))
        out.append("".join(r.choice(a) for _ in range(r.randint(1, 400))))
    for _ in range(60):
        out.append("".join(chr(r.choice([r.randrange(0x20, 0x250), r.randrange(0x20, 0xD800), r.randrange(0xE000, 0x1F900)])) for _ in range(120)))
    return out


def test_ids_and_decoding_equal_the_library(own, library):
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, t[:80]
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [2, 3, 7, 31])
def test_tree_equals_merging_the_whole(own, leaf):
    tree = Codec(PATH, leaf)
    r = random.Random(leaf)
    for _ in range(300):
        data = "".join(r.choice(r.choice(["ab", "thenigo", "=-", "éa", "0 1"])) for _ in range(r.randint(1, 300))).encode()
        assert tree.encode_piece(data) == own.merge(data)


@pytest.mark.parametrize("leaf", [1, 2, 5, 64])
def test_halves_of_texts_join_to_what_the_library_gives(library, leaf):
    tree = Codec(PATH, leaf=leaf)
    for t in texts():
        assert np.frombuffer(tree.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]
    assert tree.joins > 1000 and tree.grown > 0


def test_whole_documents_are_trees(spark, library):
    own = Codec(PATH)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    for r in rows:
        assert np.frombuffer(own.encode(r.text or ""), "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids
    assert own.joins > 100


def test_long_texts_are_rows_of_halves(spark, library):
    r = random.Random(9)
    long = ["".join(r.choice(["the ", "a'll ", "\n \n", "long", "éa ", "<|endoftext|>", "  ", "42"]) for _ in range(4000)) for _ in range(3)]
    rows = [(1, long[0], "p"), (1, long[0], "p"), (2, long[1], None), (None, long[2], "q"), (3, "short", "r"), (4, None, "s"), (5, "x" * 9000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    got = encode_documents(docs, PATH, spread=1000, keep=("doc_id", "part")).collect()
    want = sorted(((d, p, library.encode(t or "", add_special_tokens=False).ids) for d, t, p in rows), key=str)
    assert sorted(((g.doc_id, g.part, g.ids) for g in got), key=str) == want


def test_rows_of_every_kind(spark, library):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, "a b", None), (2, None, "y"), (3, "", "y"), (4, "long" * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = encode_documents(docs, PATH).collect()
    assert len(got) == len(rows)
    for g in got:
        text = next(r[1] for r in rows if r[0] == g.doc_id) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert g.ids == ids and g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert encode_documents(docs.limit(0), PATH).count() == 0
