"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all of its
segmentations into pieces of the products of their probabilities, by a forward algorithm; a text's score is the
sum of the logarithms over its words. Probabilities are learned by expectation maximisation over the same segmentations.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bounded_rows, hashed_below, map_batches, resident, stage, text_slices, unused
from tracewell.llm.tokens import public_path

STRETCH = 40  # characters; longer runs of letters are scored with rows that are carried on and rescaled
SCALE = 32.0  # keeps products of a word's probabilities away from underflow: a factor per character, taken out again
_BASE = np.uint64(0x9E3779B97F4A7C15)
START = "▁"


def vocabulary(name: str = "piece_bpe_32k.model") -> list[str]:
    """Lower-cased pieces of letters, some with a word start, in sorted order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_path(name))
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted(p for p in pieces if p.removeprefix(START).isalpha())


def letter_runs(token: str) -> list[str]:
    """The runs of letters of a token, lower-cased, each with the word start before it."""
    token = token.lower()
    word = token.rstrip(".,!?")
    runs = [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in token).split()
    return [START + r for r in runs]


class Unigrams:
    """Piece probabilities of all languages: rows are pieces, then the unknown character."""

    def __init__(self, pieces: list[str], languages: list[str]):
        self.languages, self.pieces = languages, pieces
        keys = np.array([self._key(p) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.longest = max(map(len, pieces), default=1)
        # what a piece starts with: a stretch of characters that none starts with is not looked at further
        self.starts = np.unique(np.array([self._key(p[:k]) for p in pieces for k in range(1, len(p))], dtype=np.uint64))
        self.p = np.zeros((len(pieces) + 1, max(1, len(languages))))

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _among(sorted_keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of h in the keys, and whether they are there."""
        if not len(sorted_keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)
        return at, sorted_keys[at] == h

    def lattice(self, words: list[str], starts: int | None = None) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, their pieces) for words of one length, by start (of the first `starts`): the pieces of the vocabulary that
        stand there, and the unknown character where a character is no piece."""
        n, unknown = len(words[0]), len(self.pieces)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        out = []
        for a in range(n if starts is None else starts):
            alive, h = np.arange(len(words)), np.zeros(len(words), dtype=np.uint64)
            for b in range(a + 1, min(n, a + self.longest) + 1):
                h = (h + codes[alive, b - 1]) * _BASE
                at, found = self._among(self.keys, h)
                if b == a + 1:
                    out.append((a, b, alive, np.where(found, self.order[at] if len(self.keys) else 0, unknown)))
                elif found.any():
                    out.append((a, b, alive[found], self.order[at[found]]))
                on = self._among(self.starts, h)[1]
                if not on.any():
                    break
                alive, h = alive[on], h[on]
        return out

    def forward(self, lattice: list[tuple[int, int, np.ndarray, np.ndarray]], n: int, m: int, p: np.ndarray) -> np.ndarray:
        """alpha[k]: scaled probability of the first k characters of each of m words, by language."""
        alpha = np.zeros((n + 1, m, p.shape[1]))
        alpha[0] = 1
        for a, b, at, ids in lattice:  # by start, so alpha[a] is whole when it is read
            alpha[b, at] += alpha[a, at] * p[ids] * SCALE ** (b - a)
        return alpha

    def long_run(self, word: str, block: int = 4096) -> np.ndarray:
        """log P(word) by language for a word of any length: rows of alpha are carried on and rescaled, language by language."""
        n, reach = len(word), self.longest
        rows = np.zeros((reach + 1, self.p.shape[1]))  # alpha of the positions from the present one on
        rows[0] = 1
        logs = np.zeros(self.p.shape[1])
        for first in range(0, n, block):
            part = word[first : first + block + reach - 1]
            here = min(block, n - first)
            # pieces that start at each position: columns are starts, as words of a lattice with one start
            starts = [part[k : k + reach] for k in range(here)]
            found: list[list[tuple[int, int]]] = [[] for _ in range(here)]
            by_length: dict[int, list[int]] = defaultdict(list)
            for k, s in enumerate(starts):
                by_length[len(s)].append(k)
            for ks in by_length.values():
                for _, b, at, ids in self.lattice([starts[k] for k in ks], 1):
                    for j, piece in zip(at.tolist(), ids.tolist()):
                        found[ks[j]].append((b, piece))
            for pieces in found:
                alpha = rows[0]
                for b, piece in pieces:
                    rows[b] += alpha * self.p[piece]
                rows[:-1] = rows[1:]
                rows[-1] = 0
                top = rows.max(axis=0)
                logs += np.log(top)
                rows /= top
        return logs + np.log(rows[0])

    def log_probability(self, words: list[str]) -> np.ndarray:
        """log P(word) by language, for any words."""
        out = np.empty((len(words), self.p.shape[1]))
        by_length = defaultdict(list)
        for k, w in enumerate(words):
            if len(w) > STRETCH:
                out[k] = self.long_run(w)
            else:
                by_length[len(w)].append(k)
        for n, ks in by_length.items():
            for a in range(0, len(ks), 4096):
                part = ks[a : a + 4096]
                out[part] = np.log(self.forward(self.lattice([words[k] for k in part]), n, len(part), self.p)[n]) - n * np.log(SCALE)
        return out

    def fit(self, counts: dict[str, Counter], rounds: int = 4, prior: float = 50.0) -> Unigrams:
        """Expectation maximisation per language, then each language is smoothed by all of them together.

        An unknown character is as likely in each language: what was never seen speaks for none. Runs of over STRETCH characters
        are learned from in stretches."""
        v = len(self.pieces)
        expected = np.zeros((v + 1, len(self.languages)))
        for l, language in enumerate(self.languages):
            by_length: dict[int, Counter] = defaultdict(Counter)
            for w in sorted(counts[language]):
                for part in [w] if len(w) <= STRETCH else [w[k : k + STRETCH] for k in range(0, len(w), STRETCH)]:
                    by_length[len(part)][part] += counts[language][w]
            lattices = [(n, self.lattice(list(ws)), np.array(list(ws.values()), dtype=float)) for n, ws in sorted(by_length.items())]
            p = np.full((v + 1, 1), 1.0 / (v + 1))
            for _ in range(rounds):
                total = np.zeros(v + 1)
                for n, lattice, weight in lattices:
                    alpha = self.forward(lattice, n, len(weight), p)[:, :, 0]
                    beta = np.zeros_like(alpha)
                    beta[n] = 1
                    for a, b, at, ids in reversed(lattice):
                        share = p[ids, 0] * SCALE ** (b - a) * beta[b, at]
                        beta[a, at] += share
                        total += np.bincount(ids, weights=alpha[a, at] * share / alpha[n, at] * weight[at], minlength=v + 1)
                p = ((total + 1e-3) / (total + 1e-3).sum())[:, None]
            expected[:, l] = total
        pooled = expected.sum(axis=1) + 0.01
        pooled /= pooled.sum()
        self.p = (expected + prior * pooled[:, None]) / (expected.sum(axis=0) + prior)
        known = self.p[:v]
        self.p = np.concatenate([known / known.sum(axis=0) * (1 - pooled[v]), np.full((1, len(self.languages)), pooled[v])]) if v else np.ones((1, len(self.languages)))
        return self


class Scorer:
    """Scores whole texts; each distinct token is scored once while the cache, emptied at `entries`, holds it."""

    def __init__(self, model: Unigrams, entries: int = 250_000):
        self.model, self.entries = model, entries
        self.known: dict[str, int] = {}
        self.used = 0
        self.rows = np.zeros((1 << 14, len(model.languages)), np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.used > self.entries:
            self.known.clear()
            self.used = 0
        lists = [(t or "").lower().split() for t in texts]
        new = set()
        for ts in lists:
            new.update(ts)
        new = sorted(new.difference(self.known))
        runs = [letter_runs(t) for t in new]
        words = sorted({r for rs in runs for r in rs})
        place = {w: k for k, w in enumerate(words)}
        logs = self.model.log_probability(words) if words else np.zeros((0, len(self.model.languages)))
        first, self.used = self.used, self.used + len(new)
        while first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for k, (token, rs) in enumerate(zip(new, runs)):
            self.known[token] = first + k
            self.rows[first + k] = logs[[place[r] for r in rs]].sum(axis=0) if len(rs) != 1 else logs[place[rs[0]]]
        get = self.known.__getitem__
        out = np.array([self.rows[np.fromiter(map(get, ts), np.int64, len(ts))].sum(axis=0, dtype=np.float64) if ts else np.zeros(self.rows.shape[1]) for ts in lists]).reshape(len(texts), -1)
        for token in [t for t in new if len(t) > 256]:
            del self.known[token]
        return out


def train(docs: DataFrame, max_docs: int = 600, max_bytes: int = 4 << 20, max_languages: int = 200) -> Unigrams:
    """Learn from a bounded sample: per language documents in the order of a hash of doc_id, max_docs and max_bytes of whole texts at
    most, texts that do not fit passed over; one at least, whatever its size (see bounded_rows). Rows with a null language or
    without a letter are not learned from; more than max_languages languages are an error."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts: dict[str, Counter] = {}
    if not sizes:
        return Unigrams(vocabulary(), [])
    chosen = F.lit(False)
    for lang, n in sorted(sizes.items()):
        chosen = chosen | ((F.col("lang") == lang) & hashed_below("doc_id", 1.3 * max_docs / n, 2))
    staged = stage(known.where(chosen), "langs")  # about 1.3 * max_docs rows a language
    for lang in sorted(sizes):
        counts[lang] = Counter()
        for r in bounded_rows(staged.where((F.col("lang") == lang) & F.col("text").rlike(r"\p{L}")), max_docs, max_bytes, seed=2):
            for token, n in Counter(r["text"].lower().split()).items():
                for run in letter_runs(token):
                    counts[lang][run] += n
    languages = [lang for lang in sorted(counts) if counts[lang]]
    return Unigrams(vocabulary(), languages).fit(counts)


def identify(docs: DataFrame, model: Unigrams, text: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score (the predicted language's share of the probability, 0 to 1).

    Defined results: `und` with score 0 for null texts, texts without a letter, and where no language was learned; null ids
    and repeated rows are scored like any; input columns named lang_pred or score are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", text)]
    held = unused([*kept, "lang_pred", "score"], "__text")
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(held))
    stamp = hash((tuple(model.languages), model.p.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = resident(("languages", stamp), lambda: Scorer(model))
        for batch in text_slices(batches, held, 1 << 20):
            texts = batch.column(held).to_pylist()
            if model.languages:
                logs = scorer.scores(texts)
                best = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                real = [bool(t) and any(map(str.isalpha, t)) for t in texts]
                names = [model.languages[b] if ok else "und" for b, ok in zip(best, real)]
                share = np.where(real, share, 0.0)
            else:
                names, share = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(share, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in source.schema if c.name != held), "lang_pred string", "score double"])
    return map_batches(source, run, schema)
