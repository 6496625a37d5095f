"""Exact top-k inner products with impact-ordered, score-at-a-time indexes over blocks of integer vectors.

Each block of vectors has an index: per dimension, its postings (row and value) are cut into segments of equal quantised value. For
a query the segments of all dimensions, each shifted so that the dimension's least possible contribution is zero, are
processed by descending impact, and each adds its members' contributions to their accumulators. No dimension that a row has
not been met in can add more than the impact of the next segment; so a row's score is at most its accumulator plus that
impact for each such dimension. The rows that lead are scored exactly now and then, and the k-th best of them is a threshold that
the rest must reach. Processing stops when at most `slack` rows beyond k still can, or when no segment is left; all rows
that can are rescored exactly.

A query meets its own block first. The k-th best score there is the threshold that it takes to the other blocks.

Vectors whose products might not fit 64 bits are in blocks of their own without an index. Where they meet others, all scores
are computed as doubles with a bound of their error, and the rows that can be among the k best again with whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, resident, stage

LEVELS = 32
#: Vectors with scaled components from here on are wide: their scores might not fit 64-bit integers.
LARGEST = 1 << 24
#: Blocks of queries that one task reads against a block of vectors.
AT_ONCE = 64


def quantise(vectors: list, scale: int) -> list[np.ndarray | None]:
    """floor(scale * x) of each component as double; None for vectors that take no part."""
    out = []
    for v in vectors:
        if v is None or any(x is None for x in v):
            out.append(None)
            continue
        x = np.floor(scale * np.asarray(v, dtype=np.float64))
        ok = np.isfinite(x).all() and (x >= -(2.0**63)).all() and (x < 2.0**63).all()
        out.append(x.astype(np.int64) if ok else None)
    return out


def is_wide(x: np.ndarray) -> bool:
    """True where a sum of products with a vector of the same kind, or the bounds of one, might leave 64 bits."""
    most = max(int(x.max()), -int(x.min())) if len(x) else 0
    return most >= LARGEST or most * most * len(x) >= 1 << 61


def wide_top(vectors: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int, skips: list[int | None], strip: int = 1024) -> Iterator[tuple[list[int], list[int]]]:
    """(rows, exact scores as Python integers) of the k best rows for each query, the row to skip left out, ties to the smaller id."""
    n, dims = vectors.shape
    about, slack = np.empty((len(queries), n)), np.empty((len(queries), n))
    q = queries.astype(np.float64)
    for a in range(0, n, strip):
        part = vectors[a : a + strip].astype(np.float64).T
        about[:, a : a + strip] = q @ part
        slack[:, a : a + strip] = np.abs(q) @ np.abs(part)
    slack *= (dims + 16) * 2.0**-51  # over four times what the rounding of the components, products and sums can add up to
    for j, skip in enumerate(skips):
        low, high = about[j] - slack[j], about[j] + slack[j]
        if skip is not None:
            low[skip] = high[skip] = -np.inf
        can = np.flatnonzero(high >= np.partition(low, n - k)[n - k]) if n > k else np.arange(n)
        query, found = queries[j].astype(object), []
        for a in range(0, len(can), strip):
            rows = can[a : a + strip]
            scores = (vectors[rows].astype(object) * query).sum(axis=1)
            found += [(-int(score), int(ids[row]), int(row)) for row, score in zip(rows.tolist(), scores) if row != skip]
            found = sorted(found)[:k]
        yield [row for *_, row in found], [-score for score, *_ in found]


class BlockIndex:
    """Segments of one block: per dimension, members and their values by quantised value.

    A dimension's postings lie in the order of its segments, so the segments that a query reads of it between two looks at the
    bounds are one run of them."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.members, self.values, self.cuts = [], [], []  # per dimension: rows, their values, where its segments begin and end
        for column in vectors.T:
            low, high = int(column.min()), int(column.max())
            width = max(1, -(-(high - low + 1) // LEVELS))
            order = np.argsort(column, kind="stable")
            held = column[order]
            self.members.append(order)
            self.values.append(held)
            self.cuts.append([*np.flatnonzero(np.diff((held - low) // width, prepend=-1)).tolist(), len(held)])
        # per segment, of all dimensions one after another: dimension, least and largest value
        self.dimension = np.repeat(np.arange(len(self.cuts)), np.array([len(c) - 1 for c in self.cuts], dtype=np.int64))
        ends = [(held[c[:-1]], held[np.array(c[1:]) - 1]) for held, c in zip(self.values, self.cuts)]
        self.least, self.largest = (np.concatenate([np.empty(0, np.int64), *(e[side] for e in ends)]) for side in (0, 1))
        self.room = np.empty(len(vectors), dtype=np.int64)
        self.read = self.all = 0  # segments, over all queries

    def _add(self, known: np.ndarray, query: list[int], base: list[int], taken: np.ndarray, after: np.ndarray) -> None:
        """Adds what the segments from number `taken` to number `after` of each dimension, by descending impact, give to their members."""
        for d in np.flatnonzero(after > taken).tolist():
            q, cuts = query[d], self.cuts[d]
            a, b = (cuts[-1 - after[d]], cuts[-1 - taken[d]]) if q > 0 else (cuts[taken[d]], cuts[after[d]])
            given = self.room[: b - a]
            np.multiply(self.values[d][a:b], q, out=given)
            given += base[d]
            np.add.at(known, self.members[d][a:b], given)

    def top(self, query: np.ndarray, k: int, skip: int | None = None, floor: int | None = None, slack: int = 64, check_every: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all rows that can be among the k best of the block, `skip` left out; exact scores.

        floor: a score that k other rows are known to reach; rows below it need not be found. The bounds are looked at after so many
        segments each time, a tenth of them by default."""
        n, most = len(self.vectors), k + (skip is not None)
        factor = query[self.dimension]
        bottom = np.array([q * int(v[0] if q > 0 else v[-1]) for q, v in zip(query.tolist(), self.values)], dtype=np.int64)
        shift = int(bottom.sum())
        impact = factor * np.where(factor > 0, self.largest, self.least) - bottom[self.dimension]
        segments = np.flatnonzero(factor)
        segments = segments[np.argsort(-impact[segments], kind="stable")]
        self.all += len(segments)
        rows = np.arange(n)
        can = np.ones(n, dtype=bool)
        if floor is not None:  # a product is at most that of the norms
            can = np.sqrt((query.astype(np.float64) ** 2).sum()) * self.norms * (1 + 1e-9) >= floor
            rows = np.flatnonzero(can)
        if len(rows) > most + slack:
            # the largest impact of each dimension
            start = np.array([abs(q) * int(v[-1] - v[0]) for q, v in zip(query.tolist(), self.values) if q], dtype=np.int64)
            known = np.zeros(n, dtype=np.int64)  # contributions so far, shifted; above them the number of dimensions met, where it fits
            met = 1 << 48 if int(start.sum()) < 1 << 47 else 0
            factors, base = query.tolist(), (met - bottom).tolist()
            taken = np.zeros(len(self.cuts), dtype=np.int64)
            best = None if floor is None else floor - shift
            step, i = check_every or max(1, -(-len(segments) // 10)), 0
            while i < len(segments):
                after = taken + np.bincount(self.dimension[segments[i : i + step]], minlength=len(taken))
                self._add(known, factors, base, taken, after)
                taken, i = after, min(i + step, len(segments))
                following = int(impact[segments[i]]) if i < len(segments) else 0
                rest = int(np.minimum(start, following).sum())
                sums = known & (met - 1) if met else known
                high = sums + rest - following * (known >> 48) if met else sums + rest
                high[~can] = -1
                leaders = np.argpartition(sums, n - most - 2 * k)[n - most - 2 * k :] if n > most + 2 * k else np.arange(n)
                leaders = leaders[leaders != skip] if skip is not None else leaders
                if len(leaders) >= k:
                    reached = int(np.partition(self.vectors[leaders] @ query, len(leaders) - k)[len(leaders) - k]) - shift
                    best = reached if best is None else max(best, reached)
                if best is not None:
                    can &= high >= best
                if can.sum() <= most + slack:
                    break
            self.read += i
            rows = np.flatnonzero(can)
        if skip is not None:
            rows = rows[rows != skip]
        return rows, self.vectors[rows] @ query


def sort_key(score: int) -> bytes:
    """Bytes in the order of the scores, of any size that products of 64-bit components can add up to."""
    return (score + (1 << 191)).to_bytes(24, "big")


def kind_of(wide: bool) -> str:
    return "<i8" if wide else "<i4"


def vector_blocks(vectors: DataFrame, scale: int = 1024, rows_per_block: int = 16384, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per block: block, dims, n, ids and wide and the vectors as 32-bit integers (wide ones as 64-bit); vectors that take no part are left out."""
    source = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    total = source.count()
    parts = max(1, -(-total // rows_per_block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], tuple[list, list]] = {}

        def block(kind: tuple[int, bool]) -> pa.RecordBatch:
            ids, rows = held.pop(kind)
            dims, wide = kind
            return pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int32()), "wide": [wide], "n": pa.array([len(ids)], pa.int32()), "ids": [np.array(ids, "<i8").tobytes()], "rows": [np.array(rows, kind_of(wide)).reshape(len(ids), dims).tobytes()]})

        for batch in batches:
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), quantise(batch.column("v").to_pylist(), scale)):
                if v is None:
                    continue
                kind = len(v), is_wide(v)
                ids, rows = held.setdefault(kind, ([], []))
                ids.append(vec_id)
                rows.append(v)
                if len(ids) == rows_per_block:
                    yield block(kind)
        for kind in list(held):
            yield block(kind)

    packed = map_batches(source.repartition(parts), run, "dims int, wide boolean, n int, ids binary, rows binary")
    return stage(packed.withColumn("block", F.monotonically_increasing_id()), "vectors")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, rows_per_block: int = 16384, queries_per_block: int = 256) -> DataFrame:
    """Per query row (vec_id divisible by `every`) its k highest inner products with all other rows: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id. Defined results: vectors that are null, hold null or non-finite components, or have scaled
    components that do not fit a bigint take no part, nor do rows without vec_id; a score that does not fit a bigint is null,
    its rank right all the same; vectors of different lengths are not compared;
    rows that share a vec_id are rows of their own (a query leaves out its own row alone), and each such query row is
    ranked for itself; other columns are not read.
    """
    blocks = vector_blocks(vectors, scale, rows_per_block)
    found_schema = "array<struct<query_id:bigint,own:bigint,p:bigint,vec_id:bigint,score:bigint,key:binary>>"

    def search(index: BlockIndex | None, vectors: np.ndarray, candidates: np.ndarray, own: int, places: list[int], ids: list[int], queries: np.ndarray, skips: list[int | None], floors: list[int | None]) -> list[dict]:
        """The best rows of one block for each query: through its index, or, where vectors are wide, by wide_top."""
        found = []

        def add(query_id: int, p: int, vec_id: int, score: int) -> None:
            found.append({"query_id": query_id, "own": own, "p": p, "vec_id": vec_id, "score": score if -(1 << 63) <= score < 1 << 63 else None, "key": sort_key(score)})

        if index is None:
            for p, query_id, (members, scores) in zip(places, ids, wide_top(vectors, queries, candidates, k, skips)):
                for m, score in zip(members, scores):
                    add(query_id, p, int(candidates[m]), score)
        else:
            for p, query_id, q, skip, floor in zip(places, ids, queries, skips, floors):
                members, scores = index.top(q, k, skip, floor)
                best = np.lexsort((candidates[members], -scores))[:k]
                for vec_id, score in zip(candidates[members[best]].tolist(), scores[best].tolist()):
                    add(query_id, p, vec_id, score)
        return found

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of each block, with what they find there, and the k-th best score of it as a floor."""
        resident(__name__)
        for batch in batches:
            for block, dims, wide, n, ids, rows in zip(*(batch.column(c).to_pylist() for c in ("block", "dims", "wide", "n", "ids", "rows"))):
                ids, rows = np.frombuffer(ids, "<i8"), np.frombuffer(rows, kind_of(wide)).reshape(n, dims)
                at = np.flatnonzero(ids % every == 0)
                whole = rows.astype(np.int64)
                index = BlockIndex(whole) if len(at) and not wide else None
                for a in range(0, len(at), queries_per_block):
                    p = at[a : a + queries_per_block]
                    found = search(index, whole, ids, block, p.tolist(), ids[p].tolist(), whole[p], p.tolist(), [None] * len(p))
                    scores: dict[int, list[int]] = {}
                    for x in found:
                        scores.setdefault(x["p"], []).append(x["score"])
                    floors = [scores[x][k - 1] if not wide and len(scores.get(x, ())) >= k else None for x in p.tolist()]
                    columns = {"dims": pa.array([dims], pa.int32()), "wide": [wide], "own": pa.array([block], pa.int64()), "nq": pa.array([len(p)], pa.int32()), "at": [p.astype("<i8").tobytes()], "query_ids": [ids[p].tobytes()], "queries": [rows[p].tobytes()]}
                    kind = pa.list_(pa.struct([("query_id", pa.int64()), ("own", pa.int64()), ("p", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.binary())]))
                    yield pa.RecordBatch.from_pydict(columns | {"floors": pa.array([floors], pa.list_(pa.int64())), "found": pa.array([found], kind)})

    asked = map_batches(blocks, ask, f"dims int, wide boolean, own long, nq int, at binary, query_ids binary, queries binary, floors array<bigint>, found {found_schema}")
    # every block of queries meets every other block of vectors of its length once. A block of vectors is sent to as many tasks as its
    # queries are dealt over: to keep all tasks busy, and to hold AT_ONCE blocks of queries a task at most
    asked = stage(asked, "queries")
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_blocks, n_asked = max(1, blocks.count()), asked.count()
    salts = max(1, min(n_asked, max(-(-n_asked // AT_ONCE), -(-parts // n_blocks))))
    listed = blocks.groupBy("dims").agg(F.collect_list("block").alias("blocks"))
    salted = F.pmod(F.xxhash64("own", "at"), F.lit(salts)).cast("int")
    questions = asked.join(listed, "dims").withColumn("block", F.explode("blocks")).where("block <> own").select("block", salted.alias("salt"), F.lit(1).alias("kind"), "dims", "wide", F.col("nq").alias("n"), F.col("query_ids").alias("ids"), F.col("queries").alias("rows"), "own", "at", "floors")
    indexed = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("block", "salt", F.lit(0).alias("kind"), "dims", "wide", "n", "ids", "rows", F.lit(None).cast("long").alias("own"), F.lit(None).cast("binary").alias("at"), F.lit(None).cast("array<bigint>").alias("floors"))
    met = indexed.union(questions).repartition(parts, "block", "salt").sortWithinPartitions("block", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(__name__)
        index, candidates, vectors, held_wide = None, None, None, False
        for batch in batches:
            for kind, dims, wide, n, ids, rows, own, at, floors in zip(*(batch.column(c).to_pylist() for c in ("kind", "dims", "wide", "n", "ids", "rows", "own", "at", "floors"))):
                ids, rows = np.frombuffer(ids, "<i8"), np.frombuffer(rows, kind_of(wide)).reshape(n, dims).astype(np.int64)
                if kind == 0:
                    index, vectors, candidates, held_wide = None, rows, ids, wide
                    continue
                if index is None and not wide and not held_wide:
                    index = BlockIndex(vectors)
                found = search(None if wide or held_wide else index, vectors, candidates, own, np.frombuffer(at, "<i8").tolist(), ids.tolist(), rows, [None] * n, floors)
                columns = [[x[c] for x in found] for c in ("query_id", "own", "p", "vec_id", "score", "key")]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 5 + [pa.binary()])], names=["query_id", "own", "p", "vec_id", "score", "key"])

    far = map_batches(met, run, "query_id long, own long, p long, vec_id long, score long, key binary")
    near = asked.select(F.inline("found"))
    order = Window.partitionBy("query_id", "own", "p").orderBy(F.desc("key"), "vec_id")
    ranked = near.union(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
