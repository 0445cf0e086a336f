import random
from array import array

import pytest
from tokenizers import Tokenizer

from quire.llm import bpe

PATH = bpe.default_path()
TEXTS = ["", "a\x1cb", "ΣΑΣ İ ß ﬁ", "x<|endoftext|>y don't DON'T<|startoftext|>", "!!'s 'sx ''s", "\U0001f600 á́ Ⅷ ² ٣ 12", "a" * 5000, " \n", "ẞ", "한국어 漢字テスト", "\u2028q\x85r\xa0s", "ÀÉ½ª", "the " * 3000]


@pytest.fixture(scope="module")
def both():
    return bpe.TrieBpe(PATH), Tokenizer.from_file(PATH)


def test_equal_to_the_library(both):
    mine, library = both
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choices("abcdeéß漢 '!1́σΣ　İ<|>thein", k=rng.randint(1, 80))) for _ in range(3000)]
    for text, ids in zip(texts, mine.encode_batch(texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert list(array("I", ids)) == expected
        assert mine.decode(ids).decode() == library.decode(expected, skip_special_tokens=False)


def test_every_letter_of_the_first_planes(both):
    """Each code point between letters, alone and before a mark: classes, case and composition are the library's."""
    mine, library = both
    letters = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(letters), 2000):
        texts = [f"xA{c}b {c} {c}\u0301" for c in letters[at : at + 2000]]
        expected = library.encode_batch(texts, add_special_tokens=False)
        assert [list(array("I", i)) for i in mine.encode_batch(texts)] == [e.ids for e in expected]


def test_every_token_of_the_vocabulary_and_forgetting(both, monkeypatch):
    mine, library = both
    monkeypatch.setattr(bpe, "WORD_CACHE", 50)
    monkeypatch.setattr(bpe, "PAIR_CACHE", 50)
    words = [t.replace("</w>", "") for t in list(library.get_vocab())[:4000]]
    for at in range(0, len(words), 100):
        part = words[at : at + 100]
        assert [list(array("I", i)) for i in mine.encode_batch(part)] == [library.encode(w, add_special_tokens=False).ids for w in part]


def test_columns_nulls_and_repeats(spark, both):
    docs = spark.createDataFrame([(1, "Hello", "x"), (1, "Hello", "x"), (2, None, "y"), (None, "a b", None)], "doc_id long, text string, IDS string")
    found = bpe.encode(docs)
    assert found.columns == ["doc_id", "text", "ids", "decoded"]
    rows = sorted(((r["doc_id"], list(array("I", r["ids"])), r["decoded"]) for r in found.collect()), key=str)
    hello = both[1].encode("Hello", add_special_tokens=False).ids
    assert rows == sorted([(1, hello, "hello</w>"), (1, hello, "hello</w>"), (2, [], ""), (None, both[1].encode("a b", add_special_tokens=False).ids, "a</w> b</w>")], key=str)
    assert bpe.encode(docs.limit(0), decode=False).count() == 0
