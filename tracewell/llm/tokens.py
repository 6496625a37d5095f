"""Tokenizing whole texts with public vocabularies: a word cache for the lower-casing tokenizer, chunk reuse for the byte-level one."""

from __future__ import annotations

import json
import os
import re
from itertools import chain
from sys import getsizeof

import numpy as np


def public_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine (every executor has the package)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write each byte as. Fixed: printing bytes stand for themselves, the others follow from 256."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printing else chr(next(others)) for b in range(256)]


def is_latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Marks that are taken off the ends of words and encoded by themselves: none of them shares a token with a letter or ends an added token.
MARKS = ",.!?;:$%&#*"


class WordEncoder:
    """Exact encodings by a tokenizer that drops white space, each distinct word encoded once per worker.

    No token of such a tokenizer spans white space, so a text's ids are those of its white-space separated words in
    order. The cache takes about `most` bytes in two generations: words met since the last change of generation, and those of
    the generation before, which stay if they are met again. Words beyond 64 characters are not kept.
    """

    def __init__(self, path: str, most: int = 192 << 20):
        self.tok = load(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.most, self.used = most, 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # the same model behind a splitter at white space, for words that need no other step than their bytes' letters
        from tokenizers import Tokenizer, pre_tokenizers

        self.split_words = Tokenizer(self.tok.model)
        self.split_words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {c: "".join(map(byte_letters().__getitem__, chr(c).encode())) for c in range(128, 256)}
        self.word_ends = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        self.word_ends[[i for token, i in self.tok.get_vocab().items() if token.endswith("</w>")]] = True

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters alone are single pieces and end in a token that ends a word: they are encoded many at a time."""
        ascii_words, latin, other = [], [], []
        for w in words:
            if w.isalpha() and w.islower():
                (ascii_words if w.isascii() else latin).append(w)
            else:
                other.append(w)
        if not self.word_ends.any():
            ascii_words, latin, other = [], [], words
        if not is_latin(" ".join(latin)):
            other += [w for w in latin if not is_latin(w)]
            latin = [w for w in latin if is_latin(w)]
        out = {w: np.array(e.ids, dtype=self.dtype).tobytes() for w, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False))}
        for kind in (ascii_words, latin):
            for a in range(0, len(kind), 2000):
                part = kind[a : a + 2000]
                line = " ".join(part)
                ids = np.array(self.split_words.encode_batch_fast([line if kind is ascii_words else line.translate(self.letters)], add_special_tokens=False)[0].ids, dtype=self.dtype)
                ends = ((np.flatnonzero(self.word_ends[ids]) + 1) * self.dtype.itemsize).tolist()
                raw = ids.tobytes()
                out.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends))))
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        if is_latin(text):  # lower-casing does not depend on neighbours, and NFC changes nothing
            text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split() alone
            return re.split("[ \\t\\n\\r\\x0b\\x0c\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+", text)
        return text.split()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as arrays of the smallest unsigned type that holds the vocabulary."""
        lists = [self.words(t) if t else [] for t in texts]
        if self.used > self.most // 2:
            self.older, self.known, self.used = self.known, {}, 0
        known, older, new = self.known, self.older, set()
        for ws in lists:
            new.update(ws)
        new = new.difference(known)  # looks each of the new up, where an update would walk all that is known
        new.discard("")
        known[""] = b""
        tails: dict[str, tuple[str, str]] = {}
        for w in new.difference(older):
            if w[-1] in MARKS:
                stem = w.rstrip(MARKS)
                if stem[-1:].isalpha() and stem[-1] < "\u0100":  # a letter and a mark never share a token
                    tails[w] = (stem, w[len(stem) :])
        needed = (new.difference(tails) | {part for pair in tails.values() for part in pair}).difference(known)
        missing = needed.difference(older)
        again = needed.difference(missing)
        known.update(zip(again, map(older.__getitem__, again)))
        known.update(self._encode(list(missing)))
        for w, (stem, mark) in tails.items():
            known[w] = known[stem] + known[mark]
        out = [np.frombuffer(b"".join(map(known.__getitem__, ws)), dtype=self.dtype) for ws in lists]
        for w in [w for w in (*missing, *tails) if len(w) > 64]:
            known.pop(w, None)
            missing.discard(w)
            tails.pop(w, None)
        # about the bytes of the word, of its ids and of its place in the table
        self.used += sum(map(getsizeof, chain(missing, again, tails))) + 150 * (len(missing) + len(again) + len(tails))
        return out


def cut_texts(texts: list[bytes], window: int = 16, bits: int = 7, block: int = 1 << 20) -> tuple[bytes, list[list[int]]]:
    """Content-defined cuts: all texts one after another, and per text the ends of its chunks there, where a rolling hash of the last
    `window` bytes has `bits` zero bits.

    Cuts move to the next start of a UTF-8 character. Equal stretches of text are cut alike wherever they stand, once
    a window of equal bytes has passed. The last end of a text is where it ends; an empty one has none.
    """
    data = b"".join(texts)
    raw = np.frombuffer(data, dtype=np.uint8)
    found = [np.empty(0, np.int64)]
    for first in range(0, len(raw) - window, block):  # the block's ends are first + window and the following ones
        mixed = _BYTE_CODES[raw[first : first + block + window - 1]]
        n = len(mixed) - window + 1
        total = mixed[window - 1 :].copy()
        factor = np.uint32(1)
        for k in range(1, window):  # polynomial in an odd base, modulo 2**32
            factor = np.uint32((int(factor) * 0x01000193) & 0xFFFFFFFF)
            total += mixed[window - 1 - k : window - 1 - k + n] * factor
        found.append(np.flatnonzero((total >> np.uint32(32 - bits)) == 0) + first + window)
    cuts = np.concatenate(found)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    of = np.searchsorted(ends, cuts, side="right")  # the text that a cut lies in
    cuts, of = cuts[of < len(ends)], of[of < len(ends)]
    whole = cuts - starts[of] >= window  # no window reaches over the start of a text
    cuts, of = cuts[whole], of[whole]
    while (inside := (raw[np.minimum(cuts, len(raw) - 1)] & 0xC0) == 0x80).any():
        cuts = cuts + inside
        cuts, of = cuts[cuts < ends[of]], of[cuts < ends[of]]
    cuts = np.unique(np.concatenate([cuts, ends[ends > starts]]))
    bounds = np.searchsorted(cuts, np.stack([starts, ends]), side="right").tolist() if len(ends) else [[], []]
    listed = cuts.tolist()
    return data, [listed[a:b] for a, b in zip(*bounds)]


def chunk_ends(data: bytes, window: int = 16, bits: int = 7) -> np.ndarray:
    """The ends of one text's chunks."""
    return np.array(cut_texts([data], window, bits)[1][0], dtype=np.int64)


_BYTE_CODES = np.random.default_rng(11).integers(1, 1 << 32, 256, dtype=np.uint32)

#: Places where the plain byte-level pre-tokenizer (the one with a pattern of its own) always starts a new piece, whatever stands before or after: a space before
#: a character that is no white space, and a line feed after a printing ASCII character.
AGREED = re.compile(rb" (?=[!-~\xc3-\xdf\xe4-\xf4])|(?<=[!-~])\n")
#: Classes of bytes as letters: a space, a line feed, printing ASCII (a), lead bytes that an agreed space may stand before (L), others (x).
CLASSES = bytes(c if c in b" \n" else 97 if 33 <= c <= 126 else 76 if 0xC3 <= c <= 0xDF or 0xE4 <= c <= 0xF4 else 120 for c in range(256))


def is_even(chunk: bytes) -> bool:
    """Whether every space and line feed of a chunk is an agreed place, whatever stands before or after the chunk."""
    kinds = chunk.translate(CLASSES)
    if kinds[:1] == b"\n" or kinds[-1:] == b" " or b"  " in kinds or b" x" in kinds:
        return False
    return b"\n" not in kinds or not (b" \n" in kinds or b"\n\n" in kinds or b"x\n" in kinds or b"L\n" in kinds)


def way_of(path: str, added) -> str:
    """How texts can be encoded by chunks with a vocabulary: `places`, `windows`, or `whole` (not by chunks)."""
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    step = parts.get("pre_tokenizer") or {}
    steps = step.get("pretokenizers", []) if step.get("type") == "Sequence" else [step]
    letters = set(byte_letters())
    plain = parts["model"].get("type") == "BPE" and not parts.get("normalizer") and letters <= parts["model"]["vocab"].keys() and not parts["model"].get("dropout")
    plain = plain and all(x.get("type") in ("ByteLevel", "Split") and not x.get("add_prefix_space") for x in steps) and any(x.get("type") == "ByteLevel" for x in steps)
    plain = plain and all("?<" not in str(x.get("pattern")) and x.get("behavior", "Isolated") == "Isolated" and not x.get("invert") for x in steps)  # nothing looks behind or drops text
    if not plain or any(t.lstrip or t.rstrip or t.single_word for t in added):
        return "whole"
    return "places" if [x.get("type") for x in steps] == ["ByteLevel"] and steps[0].get("use_regex", True) else "windows"


class RepairingEncoder:
    """Chunk reuse for any byte-level vocabulary: joins of chunks are repaired by re-encoding windows until the ids agree.

    Each distinct chunk is encoded by itself once and kept. A text's ids are exact up to a place where a piece of the pre-tokenizer
    starts; from there a window is encoded that reaches over the join. Where it starts a piece at a place where the next chunk's
    own encoding does too, and both have the same ids there, they agree from that place on, as pieces are found from left to
    right and depend on nothing before them. Until then the window grows, over whole chunks if need be. The last two pieces
    before a cut, and what an added token might cover, may depend on what follows: they are never taken from a cut text.
    """

    def __init__(self, tok, lengths: np.ndarray, dtype: np.dtype, margin: int, entries: int = 100_000, bits: int = 8):
        self.tok, self.lengths, self.dtype, self.margin, self.entries, self.bits = tok, lengths, dtype, margin, entries, bits
        self.chunks: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.reused = self.encoded = self.windows = 0

    def _scan(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, the place where each starts, and for each whether a piece starts there."""
        e = self.tok.encode(data.decode("utf-8"), add_special_tokens=False)
        ids = np.array(e.ids, dtype=np.int64)
        ends = np.cumsum(self.lengths[ids])
        if len(ids) and ends[-1] != len(data):
            raise ValueError("tokens do not cover the text")
        words = np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
        fresh = np.ones(len(ids), dtype=bool)
        fresh[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
        return ids, ends - self.lengths[ids], fresh

    def _trusted(self, scan: tuple[np.ndarray, np.ndarray, np.ndarray], length: int) -> int:
        """The last start of a piece that does not depend on what follows the scanned text; 0 if there is none."""
        starts = scan[1][scan[2]]
        sure = starts[:-2][starts[:-2] <= length - self.margin] if len(starts) > 2 else starts[:0]
        return int(sure[-1]) if len(sure) else 0

    def encode(self, text: str) -> np.ndarray:
        data = text.encode("utf-8")
        n, done, first, out = len(data), 0, 0, []

        def take(scan, origin: int, a: int, b: int) -> None:
            """Tokens of a scan of data[origin:] that start in [a, b)."""
            lo, hi = np.searchsorted(scan[1], [a - origin, b - origin])
            out.append(scan[0][lo:hi])

        for end in chunk_ends(data, bits=self.bits).tolist():
            chunk, start, first = data[first:end], first, end
            if chunk in self.chunks:
                self.reused += 1
            else:
                self.encoded += 1
                self.chunks[chunk] = self._scan(chunk)
            own = self.chunks[chunk]
            sure = n if end == n else start + self._trusted(own, len(chunk))
            if done == start:  # in step with the chunk from its start on
                if sure > start:
                    take(own, start, start, sure)
                    done = sure
                continue
            size = 64
            while True:  # a window from the last sure place into the chunk
                stop = min(end, start + size)
                while stop < n and data[stop] & 0xC0 == 0x80:
                    stop += 1
                self.windows += 1
                window = self._scan(data[done:stop])
                limit = n if stop == n else done + self._trusted(window, stop - done)
                place = self._agreement(window, done, own, start, limit)
                if place is not None or stop >= end:
                    break
                size *= 2
            if place is not None:
                take(window, done, done, place)
                done = place
                if sure > done:
                    take(own, start, done, sure)
                    done = sure
        if done < n:
            out.append(self._scan(data[done:])[0])
        for chunk in [c for c in self.chunks if len(c) > 4096] if len(self.chunks) > self.entries else []:
            del self.chunks[chunk]
        if len(self.chunks) > self.entries:
            self.chunks.clear()
        return np.concatenate([*out, np.empty(0, np.int64)]).astype(self.dtype)

    @staticmethod
    def _agreement(window, origin: int, own, start: int, limit: int) -> int | None:
        """The first place after the chunk's start, before limit, where both start a piece, and the same piece."""
        mine = window[1][window[2]] + origin
        theirs = own[1][own[2]] + start
        for place in np.intersect1d(mine, theirs, assume_unique=True).tolist():
            if start < place < limit:
                i, j = np.searchsorted(window[1], place - origin), np.searchsorted(own[1], place - start)
                if window[0][i] == own[0][j]:
                    return place
        return None


class ChunkEncoder:
    """Byte-level BPE with content-defined chunk reuse.

    A text is cut into rolling-hash chunks. Each distinct chunk is encoded once per worker and kept, with the texts before
    its first and after its last agreed place (where every encoding starts a new piece): what stands there depends on
    the neighbours. A join of two chunks is repaired by encoding the window from the last agreed place on the left to
    the first on the right; where a chunk has none, the window grows over it until one is found. Chunks and windows are
    encoded by the tokenizers library, piece by piece between agreed places, each distinct piece once. The caches are
    emptied when they hold `entries` chunks or `pieces` pieces; chunks over 4096 bytes and long pieces are not kept.

    Agreed places are known for the plain byte-level pre-tokenizer alone. With any other byte-level vocabulary, joins are repaired
    by RepairingEncoder; with a vocabulary that is not byte-level (`way` tells), whole texts are encoded by the library.
    """

    def __init__(self, path: str, entries: int = 100_000, pieces: int = 600_000, bits: int = 8, way: str | None = None):
        self.tok = load(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        # the same model behind a splitter at white space, for pieces of ASCII letters
        from tokenizers import Tokenizer, pre_tokenizers

        self.split_words = Tokenizer(self.tok.model)
        self.split_words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.space = byte_letters()[32]
        self.word_starts = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        self.word_starts[[i for token, i in self.tok.get_vocab().items() if token.startswith(self.space)]] = True
        self.entries, self.most, self.bits = entries, pieces, bits
        added = self.tok.get_added_tokens_decoder().values()
        self.way = way or way_of(path, added)
        if self.way == "windows":
            lengths = np.array([len(x) for x in ByteDecoder(path).table], dtype=np.int64)
            margin = max([8, *(len(t.content.encode()) for t in added)])
            self.repairing = RepairingEncoder(self.tok, lengths, self.dtype, margin, entries, bits)
        self.chunks: dict[bytes, tuple[bytes, list[bytes] | bytes, bytes, bool] | None] = {}
        self.known: dict[bytes, bytes] = {}
        self.reused = self.encoded = 0

    # A piece's key leaves out the space it starts with; a piece that starts otherwise is marked by a space, but for a line feed.
    @staticmethod
    def _key(piece: bytes) -> bytes:
        return piece if piece[0] == 10 else piece[1:] if piece[0] == 32 and len(piece) > 1 and AGREED.match(piece) else b" " + piece

    @staticmethod
    def _piece(key: bytes) -> bytes:
        return key if key[0] == 10 else key[1:] if key[0] == 32 else b" " + key

    def _keys(self, data: bytes) -> list[bytes]:
        """Keys of the pieces of a window, which starts at an agreed place or with its text."""
        cuts = [m.start() for m in AGREED.finditer(data)]
        return [self._key(data[a:b]) for a, b in zip([0, *cuts], [*cuts, len(data)]) if a < b]

    def _split(self, chunk: bytes) -> tuple[bytes, list[bytes], bytes, bool] | None:
        """(head, keys of the pieces between agreed places, tail, whether all is even); None where the chunk has no agreed place."""
        if not is_even(chunk):
            cuts = [m.start() for m in AGREED.finditer(chunk)]
            return (chunk[: cuts[0]], [self._key(chunk[a:b]) for a, b in zip(cuts, cuts[1:])], chunk[cuts[-1] :], False) if cuts else None
        parts = chunk.replace(b"\n", b" \n").split(b" ")
        return (parts[0], parts[1:-1], parts[-1] if parts[-1][0] == 10 else b" " + parts[-1], True) if len(parts) > 1 else None

    def _window(self, tail: bytes, head: bytes, even: bool) -> list[bytes]:
        """Keys of the window at a join. The tail and head of even chunks have no agreed place but the one that the tail starts with."""
        if not even:
            return self._keys(tail + head)
        return [tail + head] if tail[0] == 10 else [tail[1:] + head]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, exactly those of encode(text, add_special_tokens=False)."""
        if self.way == "windows":
            return [self.repairing.encode(t) for t in texts]
        if self.way == "whole":
            return [np.array(e.ids, dtype=self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.chunks) > self.entries:
            self.chunks.clear()
        if len(self.known) > self.most:
            self.known.clear()
        chunks, plans, fresh, need = self.chunks, [], [], set()
        start, (data, cut) = 0, cut_texts([t.encode("utf-8") for t in texts], bits=self.bits)
        for ends in cut:
            plan, window, even = [], b"", False
            for end in ends:
                chunk = data[start:end]
                start = end
                if chunk in chunks:
                    self.reused += 1
                    parts = chunks[chunk]
                else:
                    self.encoded += 1
                    parts = chunks[chunk] = self._split(chunk)
                    if parts is not None:
                        fresh.append(chunk)
                        need.update(parts[1])
                if parts is None:  # no agreement inside this chunk: the window grows
                    window, even = window + chunk, False
                else:
                    need.update(keys := self._window(window, parts[0], even and parts[3]))
                    plan.append((keys, chunk))
                    window, even = parts[2:]
            need.update(keys := self._window(window, b"", even))
            plan.append((keys, None))
            plans.append(plan)
        missing = self._learn(need)
        known, out = self.known, []
        for chunk in fresh:
            head, inner, tail, even = chunks[chunk]
            chunks[chunk] = (head, b"".join(map(known.__getitem__, inner)), tail, even)
        for plan in plans:
            got = []
            for keys, chunk in plan:
                got.extend(map(known.__getitem__, keys))
                if chunk is not None:
                    got.append(chunks[chunk][1])
            out.append(np.frombuffer(b"".join(got), dtype=self.dtype))
        for chunk in fresh:
            if len(chunk) > 4096:
                del chunks[chunk]
        for key in missing:
            if len(key) > 64:
                known.pop(key, None)
        return out

    def _learn(self, need: set[bytes]) -> list[bytes]:
        known, tails = self.known, []
        new = need.difference(known)
        for key in new:
            if key.endswith((b",", b".")) and key[-2:-1].isalpha():  # a letter and a mark never share a token
                tails.append(key)
        missing = list((new.difference(tails) | {k[:-1] for k in tails} | {b" ,", b" ."}).difference(known))
        plain = [k for k in missing if k.isalpha()]  # ASCII letters after a space: a single piece
        for a in range(0, len(plain), 2000):
            part = plain[a : a + 2000]
            line = " ".join(self.space + k.decode() for k in part)
            ids = np.array(self.split_words.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=self.dtype)
            starts = (np.flatnonzero(self.word_starts[ids]) * self.dtype.itemsize).tolist()
            raw = ids.tobytes()
            known.update(zip(part, map(raw.__getitem__, map(slice, starts, [*starts[1:], len(raw)]))))
        other = [k for k in missing if not k.isalpha()]
        encoded = self.tok.encode_batch_fast([self._piece(k).decode("utf-8") for k in other], add_special_tokens=False)
        known.update((k, np.array(e.ids, dtype=self.dtype).tobytes()) for k, e in zip(other, encoded))
        for key in tails:
            known[key] = known[key[:-1]] + known[b" " + key[-1:]]
        return [*missing, *tails]


class ByteDecoder:
    """Texts from ids, as decode(ids, skip_special_tokens=False) of a byte-level tokenizer gives them."""

    def __init__(self, path: str):
        tok = load(path)
        specials = {i: t.content for i, t in tok.get_added_tokens_decoder().items()}
        letters = {c: b for b, c in enumerate(byte_letters())}
        self.table = [b""] * tok.get_vocab_size()
        for token, i in tok.get_vocab().items():
            self.table[i] = specials[i].encode() if i in specials else bytes(letters[c] for c in token) if letters.keys() >= set(token) else token.encode()

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")
