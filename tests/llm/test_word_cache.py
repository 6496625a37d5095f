"""The cache of encoded words stays within its bytes, whatever number of words is met, and changes no ids."""

from __future__ import annotations

import tracemalloc

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tracewell.llm import arrowfiles, common, packing
from tracewell.llm.tokens import WordEncoder, public_path

WORDS = "word_bpe_49k.json"


def spelled(k: int) -> str:
    """A word of letters for each number."""
    return "".join(chr(97 + k // 26**p % 26) for p in range(6))


def test_packing_in_the_pipeline_keeps_few_words(monkeypatch):
    seen = {}
    monkeypatch.setattr(corpus_pipeline, "pack", lambda docs, **given: seen.update(given))
    corpus_pipeline.pack_sequences(None, None, "")
    try:
        encoder = arrowfiles.word_encoder(WORDS, *seen.values())
        encoder.encode_batch(["to load the library"])
        tracemalloc.start()
        for a in range(0, 600_000, 10_000):
            encoder.encode_batch([" ".join(map(spelled, range(a, a + 10_000)))])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
        common._resident.clear()
    assert held < 64 << 20


def test_small_caches_give_the_same_ids():
    rest = [spelled(k) + tail for k in range(3000) for tail in ("", ",", ".", "$$$")]
    texts = [" ".join(["often", "Été,", *rest[a : a + 60], "x" * 70 + "."]) for a in range(0, len(rest), 60)] * 2
    want = [e.ids for e in Tokenizer.from_file(public_path(WORDS)).encode_batch(texts, add_special_tokens=False)]
    for most in (0, 100_000, 1_000_000):
        encoder = WordEncoder(public_path(WORDS), most)
        made, encode = [], encoder._encode
        encoder._encode = lambda words: made.extend(words) or encode(words)
        got = [ids.tolist() for a in range(0, len(texts), 5) for ids in encoder.encode_batch(texts[a : a + 5])]
        assert got == want
        assert made.count("often") == 1  # it is met in each generation
        assert sum(map(len, (encoder.known, encoder.older))) * 150 <= most + 200_000


def test_packing_is_the_same_with_a_small_cache(spark, odd):
    whole, small = (sorted(map(tuple, packing.pack(odd, cache=cache).collect()), key=repr) for cache in (192 << 20, 0))
    assert whole == small and len(whole) > len(np.unique([x[0] or 0 for x in whole]))


def test_marks_at_the_ends_of_words_are_encoded_apart():
    texts = ["end$$$ end%%% a...!? <|endoftext|>$$ <|endoftext|>a. 1$ é## it's. 's, x'. \u65e5. ..., a$b$ e\u0301.", "$$$ . ,"]
    want = [e.ids for e in Tokenizer.from_file(public_path(WORDS)).encode_batch(texts, add_special_tokens=False)]
    encoder = WordEncoder(public_path(WORDS))
    assert [x.tolist() for x in encoder.encode_batch(texts)] == want
    made, encode = [], encoder._encode
    encoder._encode = lambda words: made.extend(words) or encode(words)
    encoder.encode_batch(["end### another$$$"])
    assert sorted(made) == ["###", "another"]  # the others are known
