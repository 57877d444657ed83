"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from ctxloom.llm import bpe
from ctxloom.llm.common import table

ODD = [
    None, "", " ", "\n\n\t", "Hello, World's 1234 tests!!", "don't we'll I'M he'd ΣΑΣ ΟΔΥΣΣΕΥΣ", "İstanbul ſharp ß ﬁ ﬂ", "é ñ ọ̈ Å", "日本語のテキスト 中文字符 한국어",
    "a b c　d\u0085e​f", "x\x1cy\x1dz\x1e1\x1f2", "emoji 😀👩‍👩‍👧 🇩🇪", "<|startoftext|>hi<|endoftext|> <|ENDOFTEXT|> <|", "a" * 5000, "ab" * 300 + "!" * 700, "٣٤٥ Ⅷ ½ ² ₃", "̀́ אְ हिन्दी",
    "tab\tnew\nline\r\nend ", "\x00\x01 ﻿ �", "it''s '' 's 'S", "snake_case __init__ a_b",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def random_texts(n):
    rng = random.Random(8)
    pools = ["abcXYZ éßñ", "0123,.!?'-_ \n", "αβΣς жЩ", "你好界 ", "́̈  ‍", "😀🏳️‍🌈 <|>", "".join(map(chr, range(0x20, 0x2ff)))]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_equals_the_library(spark, library):
    texts = ODD + random_texts(400)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as w")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == expected(library, t)[0], repr(t)
    decoded = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert all(decoded[i] == expected(library, t)[1] for i, t in enumerate(texts))


def test_documents_equal_the_library(spark, library):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs, digests=True).collect():
        ids, text = expected(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_transducer(tmp_path):
    rng = random.Random(1)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))): None for _ in range(500)}
    words = {w: [i, i + 1] for i, w in enumerate(words)}
    t = bpe.Transducer.compile(words)
    t.save(str(tmp_path / "t"))
    t = bpe.Transducer.load(str(tmp_path / "t"))
    ranks = t.rank([*words, b"", b"zz", b"a" * 30])
    assert ranks[:-3].tolist() == [sorted(words).index(w) for w in words] and ranks[-3:].tolist() == [-1] * 3
    states = len(t.final)
    assert states < sum(map(len, words)) / 2  # suffixes are shared
    assert bpe.Transducer.compile({}).rank([b"a"]).tolist() == [-1]


def test_frequent_words_are_exact(spark):
    texts = ["b b b a a c", "a C c d", None, "e1f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert bpe.frequent_words(df, 3) == ["a", "b", "c"]
    assert bpe.frequent_words(df, 100) == ["a", "b", "c", "d", "e", "f"]
    assert bpe.frequent_words(df.limit(0), 3) == []


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), digests=True).count() == 0


def test_used_units_outlive_a_full_cache(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 40)
    encoder, learned, learn = bpe.Encoder(bpe.Vocabulary(bpe.default_vocabulary()), None), [], bpe.Encoder._learn
    monkeypatch.setattr(bpe.Encoder, "_learn", lambda self, new: (learned.extend(new), learn(self, new))[1])
    texts = [f"qwertuio qwertuio <|endoftext|> {' '.join(f'{a}{b}{i}xyz,' for a in 'bcd' for b in 'lmn')}" for i in range(60)]
    for text in texts:
        assert encoder.encode([text, None])[0].tolist() == expected(library, text)[0]
    assert learned.count("qwertuio") == 1 and learned.count("b" + "l1xyz,") == 1
    assert len(encoder.known) < 80


def test_pieces_merged_together_equal_the_library(library):
    rng = random.Random(5)
    vocabulary = bpe.Vocabulary(bpe.default_vocabulary())
    pieces = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for pool in ("abcdeorstn", "aab", "éßñжщ", "你好", "!.-") for _ in range(300)]
    size, ids = vocabulary.merge_all(pieces)
    for piece, got in zip(pieces, np.split(ids, np.cumsum(size)[:-1]), strict=True):
        assert got.tolist() == expected(library, piece)[0], piece
    assert [len(x) for x in vocabulary.merge_all([])] == [0, 0]
