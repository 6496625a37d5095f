"""Token operators against the tokenizers library itself."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from tracewell.llm import arrowfiles, packing
from tracewell.llm.bpe import bpe_decode, bpe_encode
from tracewell.llm.tokens import AGREED, ByteDecoder, ChunkEncoder, WordEncoder, byte_letters, chunk_ends, cut_texts, is_even, public_path

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"
PIECES = ["a", "B", "é", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "23", "\u3000", "\xa0", "\x1c", "日本", "Σ", "İ", "<|endoftext|>", "<|startoftext|>", "e\u0301", "😀", "\r\n", "-", "$$$", "\u200b", "\x85", "ﬁ", "the ", " word,", " Word. ", "ª", "ß"]


@pytest.fixture(scope="module")
def libraries():
    return {n: Tokenizer.from_file(public_path(n)) for n in (WORDS, BYTES)}


def some_texts(n, seed=1):
    r = random.Random(seed)
    shared = ["".join(r.choice(PIECES) for _ in range(60)) for _ in range(4)]
    return ["".join(r.choice([*PIECES, *shared]) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_encoders_agree_with_the_library(libraries):
    texts = some_texts(250)
    for encoder, name in ((WordEncoder(public_path(WORDS)), WORDS), (ChunkEncoder(public_path(BYTES)), BYTES), (ChunkEncoder(public_path(BYTES), entries=20, pieces=30, bits=2), BYTES)):
        want = [e.ids for e in libraries[name].encode_batch(texts, add_special_tokens=False)]
        for _ in range(2):  # the second time from the caches
            assert [x.tolist() for x in encoder.encode_batch(texts)] == want


@pytest.fixture(scope="module")
def second(tmp_path_factory):
    """Another byte-level vocabulary, made by hand: bytes and a few merges behind the public pattern of larger vocabularies."""
    from tokenizers import AddedToken, Regex, decoders, models, pre_tokenizers

    letters = byte_letters()
    merges = [("t", "h"), ("th", "e"), ("\u0120", "the"), ("\u0120", "\u0120"), ("w", "o"), ("wo", "r"), ("\u0120", "wor"), ("a", "B"), ("1", "2"), ("12", "3"), ("\u010a", "\u010a"), (".", "\u010a"), ("$", "$"), ("$$", "$"), ("r", "d")]
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*letters, *(a + b for a, b in merges)]))}
    tok = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    pattern = r"(?i:'s|'t|'re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tok.decoder = decoders.ByteLevel()
    tok.add_special_tokens([AddedToken("<|endoftext|>", special=True), AddedToken("<|startoftext|>", special=True)])
    path = str(tmp_path_factory.mktemp("vocabulary") / "second.json")
    tok.save(path)
    return path


def test_joins_are_repaired_until_they_agree(second, libraries):
    """Any byte-level vocabulary gives the library's ids through windows, with cuts at almost every place; reuse is real."""
    texts = [*some_texts(250, 5), "<|endof" + "text|>" * 3 + " x<|endoftext|>y" * 20, " " * 300 + "the", "12345678901234567890" * 9, "the \n\n  \r\n.\n" * 40, "$" * 500 + "\n" * 70, ("the word " * 40 + "A" * 90) * 6, "日本語" * 100]
    for path, way in ((second, None), (public_path(BYTES), "windows")):
        tok = Tokenizer.from_file(path)
        want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        for bits, entries in ((2, 100_000), (4, 30), (8, 100_000)):
            encoder = ChunkEncoder(path, entries=entries, bits=bits, way=way)
            assert encoder.way == "windows"
            assert [x.tolist() for x in encoder.encode_batch(texts)] == want
        again = encoder.repairing.encoded
        assert [x.tolist() for x in encoder.encode_batch(texts)] == want and encoder.repairing.encoded == again and encoder.repairing.windows
        decoder = ByteDecoder(path)
        assert [decoder.decode(x) for x in want] == [tok.decode(x, skip_special_tokens=False) for x in want]
    assert ChunkEncoder(public_path(BYTES)).way == "places" and ChunkEncoder(public_path(WORDS)).way == "whole"


def test_agreed_places_are_safe(libraries):
    tok = libraries[BYTES]
    for text in some_texts(80, 2):
        data = text.encode()
        whole = tok.encode(text, add_special_tokens=False).ids
        for m in AGREED.finditer(data):
            left, right = data[: m.start()].decode(), data[m.start() :].decode()
            assert tok.encode(left, add_special_tokens=False).ids + tok.encode(right, add_special_tokens=False).ids == whole


def test_chunks_are_shared():
    r = random.Random(3)
    passage = bytes(r.randrange(97, 123) for _ in range(6000))
    a, b = b"x" * 37 + passage, passage[100:] + b"yy"
    cut = lambda d: {d[s:e] for s, e in zip([0, *chunk_ends(d)], chunk_ends(d))}
    assert len(cut(a) & cut(b)) >= 0.7 * len(cut(b))
    for text in some_texts(50, 4):
        data = text.encode()
        ends = chunk_ends(data, bits=3).tolist()
        assert b"".join(data[s:e] for s, e in zip([0, *ends], ends)) == data
        assert all(data[s:e].decode() is not None for s, e in zip([0, *ends], ends))


def test_texts_are_cut_alike_together_and_alone():
    """Cuts do not depend on the texts before and after, nor on the blocks that the hash is computed in."""
    texts = [t.encode() for t in [*some_texts(120, 8), "", "a", "日本語" * 60, "", "x" * 16, "\N{GRINNING FACE}" * 40, ""]]
    for bits, block in ((1, 7), (3, 64), (5, 1 << 20)):
        data, cut = cut_texts(texts, bits=bits, block=block)
        assert data == b"".join(texts) and len(cut) == len(texts)
        before = 0
        for text, ends in zip(texts, cut):
            assert [e - before for e in ends] == chunk_ends(text, bits=bits).tolist()
            before += len(text)
    assert cut_texts([]) == (b"", []) and cut_texts([b"", b""]) == (b"", [[], []])


def test_even_chunks():
    """Every space and line feed of an even chunk is an agreed place wherever the chunk stands; windows at joins are read right."""
    r = random.Random(9)
    for _ in range(4000):
        chunk = "".join(r.choice(["a", " ", "\n", "é", "日", "\t", ".", "7", "\u00a0", "ß"]) if r.random() < 0.5 else "w" for _ in range(r.randint(1, 9))).encode()
        places = [m.start() + 1 for m in AGREED.finditer(b"a" + chunk + b" ")]
        marks = [i + 1 for i, c in enumerate(chunk) if c in b" \n"]
        assert is_even(chunk) == (chunk[:1] != b"\n" and chunk[-1:] != b" " and [p - 1 for p in places] == marks) or chunk[:1] == b"\n"


def test_bpe_query(spark, odd, none, libraries):
    rows = bpe_encode(odd).collect()
    tok = libraries[BYTES]
    want = defaultdict(list)
    for d, t, *_ in ODD:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want[d].append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["decoded"]))
    assert got == want
    assert bpe_encode(none).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe_decode(bpe_encode(odd)).collect()}
    assert back == {d: t or "" for d, t, *_ in ODD}
    assert ByteDecoder(public_path(BYTES)).decode([]) == ""


def test_token_files(spark, odd, none, libraries, tmp_path):
    tok = libraries[WORDS]
    for length in (8, 2048):
        manifest = arrowfiles.write_token_files(odd, f"file://{tmp_path}/{length}", end_id=2, length=length, rows_per_batch=4)
        rows = arrowfiles.read_token_files(manifest).orderBy("start").collect()
        ids = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for _, t, *_ in ODD]
        order = sorted(range(len(ODD)), key=lambda k: (ODD[k][0] is not None, ODD[k][0] or 0))
        starts = np.cumsum([0, *(len(ids[k]) for k in order)]).tolist()
        want = [(ODD[k][0], s, len(ids[k]), zlib.crc32(ids[k].tobytes())) for k, s in zip(order, starts)]
        assert [tuple(r) for r in rows] == want
        stream = np.concatenate([ids[k] for k in order])
        at = 0
        for m in sorted(manifest.collect(), key=lambda m: m["part"]):
            reader = arrowfiles.TokenReader(m["file"])
            assert m["base"] == at
            for k in range(-(-m["n_tokens"] // length)):
                view, mask = reader.sequence(k)
                real = min(length, m["n_tokens"] - k * length)
                assert len(view) == length and not view.flags.owndata and mask.to_pylist() == [j < real for j in range(length)]
                assert view[:real].tolist() == stream[at + k * length : at + k * length + real].tolist()
            at += m["n_tokens"]
    empty = arrowfiles.write_token_files(none, f"file://{tmp_path}/none")
    assert empty.count() == 0 and arrowfiles.read_token_files(empty).count() == 0


def test_lost_attempts_are_not_read(spark, odd, tmp_path):
    manifest = arrowfiles.write_token_files(odd, f"file://{tmp_path}/files")
    (tmp_path / "files" / "part-00000-lost.arrow").write_bytes(b"half a file")
    assert arrowfiles.read_token_files(manifest).count() == len(ODD)


def cost(pos, penalty, cuts, length, window_cost, powers):
    total = 0.0
    for a, b in zip(cuts, cuts[1:]):
        size = pos[b] - pos[a]
        assert 0 < size <= length
        total += (0 if size in powers else length - size) + penalty[b] + window_cost
    return total


def test_cuts_are_optimal():
    r = random.Random(5)
    for _ in range(150):
        length = r.choice([8, 16])
        pos = [0]
        for _ in range(r.randint(1, 12)):
            pos.append(pos[-1] + r.randint(1, length // 2))
        penalty = np.array([0.0] + [r.choice([0.0, 2.0, 9.0]) for _ in pos[1:]])
        powers = tuple(1 << k for k in range(length.bit_length()) if length // 8 <= 1 << k <= length)
        best = [0.0] + [float("inf")] * (len(pos) - 1)
        for j in range(1, len(pos)):
            for i in range(j):
                size = pos[j] - pos[i]
                if size <= length:
                    best[j] = min(best[j], best[i] + (0 if size in powers else length - size) + penalty[j] + 4.0)
        cuts = packing.best_cuts(np.array(pos), penalty, length, 4.0, powers)
        assert cost(pos, penalty, cuts, length, 4.0, powers) == pytest.approx(best[-1])


def test_packing(spark, odd, none, libraries):
    tok = libraries[WORDS]
    rows = packing.pack(odd, stretch=3000, keep_ids=True).orderBy("sequence_id", "offset").collect()
    fill = defaultdict(int)
    for r in rows:
        assert fill[r["sequence_id"]] == r["offset"] and zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))
    for doc_id in {d for d, *_ in ODD}:
        texts = [t or "" for d, t, *_ in ODD if d == doc_id]
        ids = tok.encode(texts[0], add_special_tokens=False).ids + [1]
        pieces = [r for r in rows if r["doc_id"] == doc_id]
        assert sorted((r["start"] for r in pieces)).count(0) == len(texts)
        assert all(r["doc_tokens"] == len(ids) and r["ids"] == ids[r["start"] : r["start"] + r["length"]] for r in pieces)
        assert sum(r["length"] for r in pieces) == len(ids) * len(texts)
    assert packing.pack(none).count() == 0


def test_little_padding(spark):
    r = random.Random(6)
    text = lambda: " ".join(r.choice(["the", "of", "river", "stone", "under", "bridge."]) for _ in range(r.randint(5, 700)))
    docs = spark.createDataFrame([(k, text()) for k in range(400)], "doc_id long, text string").coalesce(1)
    sizes = [r["n"] for r in packing.pack(docs).groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding < 0.05 * sum(sizes) + 4 * 2048


def test_sentence_ends():
    ends = packing.sentence_ends({".</w>": 0, "a</w>": 1, "!?</w>": 2, ".": 3, "</w>": 4})
    assert ends.tolist() == [True, False, True, False, False]
