"""Ids of words in lines against those of the library, text by text."""

import random

import pyarrow as pa

from factloom.llm import queries, tokens

ODD = "abcXYZİßéÉñ中文ſKΩΣςأ́̇'.,;:!?\"#$%&()*+-/<=>@[]\\^_`{}~0129 \t\n\x0b\x1c\x85\xa0　​\U0001f600²ǅªⅣﬁ가각"


def same(enc, texts):
    ids, counts = enc.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in enc.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    return ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))


def test_ids_of_odd_texts_are_those_of_the_library():
    rng = random.Random(6)
    enc = tokens.WordEncoder(queries.word_bpe())
    for letters in (ODD, "ab'stredlmv.,! ", "aé中 "):
        for _ in range(40):
            assert same(enc, ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(40)])
    assert same(enc, ["don't, we'll. x's? 'tis", "</w> a</w>,b abc</w>", "a'.'b'", None, ""])
    assert same(enc, ["one, two.", "a, b<|endoftext|>c, d. <|startoftext|>E, f <|endoftext"])


def test_words_that_differ_in_punctuation_are_encoded_once():
    enc = tokens.WordEncoder(queries.word_bpe())
    enc.encode(pa.array(["River, river. (river) river; RIVER!"]))
    assert {w for w in enc.cache if "river" in w} == {"river", "(river"}


def test_letters_go_through_the_library_in_lines():
    enc = tokens.WordEncoder(queries.word_bpe())
    sequences = []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            sequences.extend(texts)
            return library.encode_batch_fast(texts, **kw)

    library, enc.tokenizer = enc.tokenizer, Counted()
    words = [a + b + c for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    enc.encode(pa.array([" ".join(words)]))
    assert sequences == [" ".join(words)]
