"""Order-preserving packing of token streams into windows by dynamic programming with a monotone queue.

Documents are taken in doc_id order, each with an end id, as one stream. Windows of at most `length` ids may be cut at the
ends of documents, at the ends of sentences, and in the middle of stretches that have neither. The cost of a cutting is its
padding plus a penalty for each cut inside a document plus a small cost per window; a window whose size is a power of two
needs no padding. With f(j) the least cost up to cut j at position p(j),

    f(j) = penalty(j) + window_cost + min( min over p(j) - p(i) <= length of f(i) + p(i), plus length - p(j);
                                           f(i) where p(j) - p(i) is a power of two )

and the inner minimum over the sliding range of i is kept in a monotone queue, so each cut enters and leaves it once.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrowfiles import word_encoder
from tracewell.llm.common import in_id_order, map_batches, running_base, stage, text_slices


def sentence_ends(vocab: dict[str, int]) -> np.ndarray:
    """For each id, whether its token ends a sentence: it ends a word in a full stop, question or exclamation mark."""
    out = np.zeros(max(vocab.values()) + 1, dtype=bool)
    for token, i in vocab.items():
        out[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?") and token.endswith("</w>")
    return out


_ends: dict[str, np.ndarray] = {}


def candidates(doc_ends: np.ndarray, ends: np.ndarray, sentence: float, hard: float, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) of the allowed cuts, 0 and the stream's end included: positions after which a window may end."""
    total = int(doc_ends[-1])
    kind = np.zeros(total + 1, dtype=np.int8)  # 0: no cut, 1: hard, 2: sentence, 3: document
    kind[ends] = 2
    kind[doc_ends] = 3
    kind[0] = 3
    pos = np.flatnonzero(kind)
    for k in np.flatnonzero(np.diff(pos) > 2 * step).tolist():
        kind[pos[k] + step : pos[k + 1] - step // 2 : step] = 1
    pos = np.flatnonzero(kind)
    return pos, np.array([0.0, hard, sentence, 0.0])[kind[pos]]


def best_cuts(pos: np.ndarray, penalty: np.ndarray, length: int, window_cost: float, powers: tuple[int, ...]) -> list[int]:
    """Indices into pos of the cheapest cutting, first and last included."""
    n = len(pos)
    where = np.full(int(pos[-1]) + 1, -1, dtype=np.int32)
    where[pos] = np.arange(n)
    jumps = []
    for p in powers:
        back = np.full(n, -1, dtype=np.int32)
        far = pos >= p
        back[far] = where[pos[far] - p]
        jumps.append(back.tolist())
    p_list, pen = pos.tolist(), (penalty + window_cost).tolist()
    f, came = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    g = [0.0] * n  # f(i) + p(i)
    for j in range(1, n):
        at = p_list[j]
        low = at - length
        while p_list[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = g[i] + length - at
        for back in jumps:
            k = back[j]
            if k >= 0 and f[k] < best:
                best, i = f[k], k
        best += pen[j]
        f[j], came[j] = best, i
        value = g[j] = best + at
        while queue and g[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def pack_stream(docs: list[tuple[int | None, np.ndarray]], ends_of: np.ndarray, length: int = 2048, sentence: float = 2.0, hard: float = 32.0, window_cost: float = 4.0) -> list[tuple]:
    """Pieces (doc_id, start, length, crc32, doc_tokens, sequence, offset, ids) of one stretch of documents in order."""
    if not docs:
        return []
    lengths = np.array([len(x) for _, x in docs], dtype=np.int64)
    doc_ends = np.cumsum(lengths)
    stream = np.concatenate([x for _, x in docs])
    pos, penalty = candidates(doc_ends, np.flatnonzero(ends_of[stream]) + 1, sentence, hard, length // 8)
    powers = tuple(1 << k for k in range(length.bit_length()) if length // 8 <= 1 << k < length)  # a full window needs no padding anyway
    cuts = pos[best_cuts(pos, penalty, length, window_cost, powers)].tolist()
    out, d, doc_start = [], 0, 0
    for seq, (a, b) in enumerate(zip(cuts, cuts[1:])):
        at = a
        while at < b:
            end = min(b, int(doc_ends[d]))
            ids = stream[at:end]
            out.append((docs[d][0], at - doc_start, end - at, zlib.crc32(ids.astype("<u4").tobytes()), int(lengths[d]), seq, at - a, ids))
            at = end
            if at == doc_ends[d]:
                doc_start = at
                d += 1
    return out


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, length: int = 2048, stretch: int = 1 << 21, keep_ids: bool = False, cache: int = 192 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids with keep_ids.

    Each id of a text and its end id lie in exactly one piece. Stretches of about `stretch` tokens of a task are packed each
    for itself, which bounds memory and costs one padded window a stretch. A Python worker keeps about `cache` bytes of encoded
    words; fewer cost time, and change no result. Defined results: null texts are empty ones (one
    piece, the end id); null doc_ids come first; repeated rows are packed one after another; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary, cache)
        if vocabulary not in _ends:
            _ends[vocabulary] = sentence_ends(encoder.tok.get_vocab())
        ends_of = _ends[vocabulary]
        part, sequences, held, n_held = TaskContext.get().partitionId(), 0, [], 0
        end = np.array([end_id], dtype=encoder.dtype)

        def flush() -> pa.RecordBatch:
            nonlocal sequences, held, n_held
            rows = pack_stream(held, ends_of, length)
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(np.array(columns[5]) + sequences, pa.int64()), pa.array(columns[6], pa.int64()), pa.array([part] * len(rows), pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "local", "offset", "part"]
            if keep_ids:
                arrays.append(pa.array([x.tolist() for x in columns[7]], pa.list_(pa.int32())))
                names.append("ids")
            sequences += columns[5][-1] + 1
            held, n_held = [], 0
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in text_slices(batches, "__text", 1 << 19):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_batch(batch.column("__text").to_pylist())):
                held.append((doc_id, np.concatenate([ids, end])))
                n_held += len(ids) + 1
                if n_held >= stretch:
                    yield flush()
        if held:
            yield flush()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local long, offset long, part int" + ", ids array<int>" * keep_ids
    pieces = stage(map_batches(in_id_order(docs), run, schema), "pieces")
    parts = running_base(pieces.groupBy("part").agg((F.max("local") + 1).alias("n")), "part", "n").drop("n")
    placed = pieces.join(F.broadcast(parts), "part").withColumn("sequence_id", F.col("base") + F.col("local"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids)
