"""N-gram Jaccard join as a blocked sparse matrix product of documents by n-grams.

Documents with the same shingle set are one row of the matrix. For J >= t two sets must share an n-gram among the first
n - ceil(t n) + 1 of each, in any one order of all n-grams, so only those columns are multiplied: blocks of columns go to tasks
by hash, each task joins the postings of its columns, and the overlap counts of a pair are summed over blocks. With c shared
n-grams in the two prefixes, the overlap is c plus what is left behind the earlier-ending prefix at most; pairs
below the overlap that their sizes demand are dropped, and the others' whole sets are intersected.

The order puts n-grams of many documents last, so passages that a large part of the corpus shares make no pairs of
documents that are otherwise different. Large groups of near copies would still make all of their pairs; so the product
is made in two parts. First its rows for the leaders alone, the least document of each column: one row a posting, however many
documents a column has. Documents that link with a leader get its label, and the second part is made between documents
of different labels. It misses no link between components: what it leaves out is connected already.

Columns that still hold many documents (groups of near copies that are not near enough to link) make no rows for their pairs
either. Documents that share such columns form a family; a family is cut by size, as only sets of like sizes can link, and
then into tiles; each pair of tiles is one block of the product over whole sets, computed in one task, which
returns a spanning forest of the links it found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, stage, text_slices, utf8_parts
from tracewell.llm.components import components
from tracewell.llm.shingles import shingle_sets

#: Common n-grams are looked for among those whose hash lies in this part of the range; prefixes hardly reach beyond it.
REGION = 0.25
#: n-grams of fewer documents are not moved back; the list of common ones is cut to MOST_COMMON (8 bytes each) by count.
COMMON, MOST_COMMON = 64, 500_000
#: Ids that a closure may carry (8 bytes each); beyond that many, texts are joined to ids by a shuffle.
MOST_IDS = 1_000_000
#: Columns of more documents are multiplied by tiles; a tile has about TILE documents and TILE_GRAMS n-grams at most.
HEAVY, TILE, TILE_GRAMS = 64, 512, 1_000_000
#: Families of more documents are not multiplied as a whole but column by column.
LARGEST_FAMILY = 500_000


def prefix_size(n: int, percent: int) -> int:
    """n - ceil(percent / 100 * n) + 1."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return shingle_sets(*utf8_parts(batch.column("text")), k)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def common_grams(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of the n-grams in REGION that COMMON documents or more hold, counted over all documents; sorted."""
    limit = np.uint64(int(REGION * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            grams = np.concatenate([np.empty(0, np.uint64), *[s[: np.searchsorted(s, limit)] for s in _sets(batch, k)]])
            distinct, n = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n)], names=["gram", "n"])

    # one row an n-gram and slice of texts is shuffled; few of them are common
    counted = map_batches(docs.select("text"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    counted = stage(counted, "common")
    by_count = sorted((r["b"], r["c"]) for r in counted.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect())
    least, room = math.inf, MOST_COMMON
    for b, c in reversed(by_count):
        if c > room:
            break
        room -= c
        least = b
    rows = counted.where(F.floor(F.log2("n")) >= (least if least != math.inf else 99)).select("gram").toArrow()
    return np.sort(rows.column("gram").to_numpy().astype(np.int64).view(np.uint64))


def _ranked(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Ascending n-grams in the order of the join: those that are not common, then the common ones."""
    if not len(common) or not len(grams):
        return grams
    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    late = common[at] == grams
    return np.concatenate([grams[~late], grams[late]])


def document_rows(docs: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """Per row: doc_id, n, signature of the set, and prefix in the order of the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sets = _sets(batch, k)
            signs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            heads = [_ranked(s, common)[: prefix_size(len(s), percent)] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(signs, pa.binary()), _longs(heads)], names=["doc_id", "n", "sign", "prefix"])

    return map_batches(docs, run, "doc_id long, n long, sign binary, prefix array<long>")


def _whole_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, grams) of the documents named in ids (column id)."""
    n = ids.count()
    if n <= MOST_IDS:
        wanted = np.sort(ids.toArrow().column("id").to_numpy())

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("doc_id").to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(wanted, own), max(0, len(wanted) - 1))
                keep = wanted[at] == own if len(wanted) else np.zeros(len(own), bool)
                yield from _grams([batch.filter(pa.array(keep))], k)

        rows = map_batches(docs, pick, "id long, grams array<long>")
    else:
        met = docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        rows = map_batches(met, lambda batches: _grams(batches, k), "id long, grams array<long>")
    return rows


def _grams(batches, k: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(iter(batches), "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _longs(_sets(batch, k))], names=["id", "grams"])


def _needed(percent: int, a: str, b: str):
    """The least overlap of sets of these sizes with 100 * overlap >= percent * union, as an expression."""
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / F.lit(100 + percent))


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """Of pairs (a, na, b, nb), those that link, as (a, b): the whole sets are intersected."""
    ids = stage(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), f"{name}-ids")
    sets = stage(_whole_sets(docs, ids, k), f"{name}-sets")
    # rows of one id with different texts are told apart by their size alone; equal sizes are both tried
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    met = pairs.join(left, "a").join(right, "b").where((F.size("ga") == F.col("na")) & (F.size("gb") == F.col("nb")))
    shared = F.size(F.array_intersect("ga", "gb"))
    return stage(met.where(shared * 100 >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b").distinct(), f"{name}-links")


def forest(links: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (pairs of positions below n)."""
    parent, out = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            out.append((a, b))
    return out


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, width: int = 4096) -> np.ndarray:
    """Links (positions) between the sets at left and those at right: overlap counts are added up over blocks of columns, and the
    product ends early when no pair can reach the overlap that its sizes demand any more."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, column, held = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    rows, column = rows[shared], column[shared]
    number = np.cumsum(held > 1) - 1
    column = number[column]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    n = np.array([len(s) for s in sets])
    need = -(-percent * (n[left][:, None] + n[right][None, :]) // (100 + percent))
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    rest = np.bincount(rows, minlength=len(sets))
    here = np.full(len(sets), -1)
    here[left] = np.arange(len(left))
    there = np.full(len(sets), -1)
    there[right] = np.arange(len(right))
    columns = int(number[-1]) + 1 if len(number) else 0
    for first in range(0, columns, width):
        a, b = np.searchsorted(column, [first, first + width])
        r, c = rows[a:b], column[a:b] - first
        x = np.zeros((len(left), width), dtype=np.float32)
        y = np.zeros((len(right), width), dtype=np.float32)
        x[here[r][here[r] >= 0], c[here[r] >= 0]] = 1
        y[there[r][there[r] >= 0], c[there[r] >= 0]] = 1
        counts += x @ y.T
        rest -= np.bincount(r, minlength=len(sets))
        if not (counts + np.minimum(rest[left][:, None], rest[right][None, :]) >= need).any():
            return np.empty((0, 2), dtype=np.int64)
    i, j = np.nonzero((counts >= need) & (need > 0))
    return np.stack([left[i], right[j]], axis=1)


def _heavy_links(docs: DataFrame, heavy: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links (a, b) among documents that share a heavy column (gram, id, n, label), by tiles; a forest per pair of tiles."""
    heavy = stage(heavy, "heavy")
    if heavy.isEmpty():
        return None
    lead = heavy.groupBy("gram").agg(F.min("id").alias("lead"))
    families = stage(components(heavy.join(lead, "gram").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()), "families")
    sizes = families.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    placed = heavy.join(families.join(sizes, "component"), F.col("id") == F.col("node"))
    whole = F.col("m") <= LARGEST_FAMILY
    # sets of classes that are not neighbours differ too much in size to link
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.0001 * math.log(100 / percent))) if percent < 100 else F.col("n")
    members = stage(placed.select(whole.alias("family"), F.when(whole, F.col("component")).otherwise(F.col("gram")).alias("key"), "id", "n", "label").distinct().withColumn("size", size_class.cast("long")), "members")
    mixed = members.groupBy("family", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("family", "key")
    tiles = members.join(mixed, ["family", "key"], "left_semi").groupBy("family", "key", "size").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_GRAMS)).cast("int").alias("tiles"))
    # the tiles that a class meets: its own, the next class's as the left side, the one before's as the right side
    meets = tiles.select("family", "key", "size", "tiles", F.col("tiles").alias("others"), F.lit(0).alias("step"))
    for step in (-1, 1):
        meets = meets.union(tiles.join(tiles.select("family", "key", (F.col("size") - step).alias("size"), F.col("tiles").alias("others")), ["family", "key", "size"]).select("family", "key", "size", "tiles", "others", F.lit(step)))
    # staged, their size is known: they are broadcast, or a class of many members is split; planned together, each class would be one task's
    meets = stage(meets, "meets")
    sets = stage(_whole_sets(docs, members.select("id").distinct(), k), "heavy-sets")
    own, other, step = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"), F.col("other"), F.col("step")
    rows = members.join(meets, ["family", "key", "size"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    i = F.when(step == 0, F.least("own", other)).when(step > 0, F.col("own")).otherwise(other)
    j = F.when(step == 0, F.greatest("own", other)).when(step > 0, other).otherwise(F.col("own"))
    side = F.when((step == 0) & (F.col("own") == other), 2).otherwise(F.when(step == 0, (F.col("own") > other).cast("int")).otherwise((step < 0).cast("int")))
    block = [(F.col("size") + F.least(step, F.lit(0))).alias("low"), (step != 0).alias("across"), i.alias("i"), j.alias("j")]
    at_block = ["family", "key", "low", "across", "i", "j"]
    rows = rows.select("family", "key", *block, side.cast("int").alias("side"), "id", "n", "label").join(sets, "id").where(F.size("grams") == F.col("n")).drop("n")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *at_block).sortWithinPartitions(*at_block, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def links() -> pa.RecordBatch:
            sides, ids, labels = (np.array([h[c] for h in held]) for c in range(3))
            found = block_links([h[3] for h in held], np.flatnonzero(sides != 1), np.flatnonzero(sides != 0), percent)
            a, b = found.T
            found = found[((sides[a] != 2) | (ids[a] < ids[b])) & (labels[a] != labels[b])]
            pairs = np.array(forest(found, len(held)), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]].astype(np.int64)), pa.array(ids[pairs[:, 1]].astype(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in at_block))
            grams = batch.column("grams")
            offsets = grams.offsets.to_numpy()
            flat = grams.values.to_numpy().view(np.uint64)
            for r, (key, side, doc_id, label) in enumerate(zip(keys, *(batch.column(c).to_pylist() for c in ("side", "id", "label")))):
                if key != at:
                    if held:
                        yield links()
                    at, held = key, []
                held.append((side, doc_id, label, flat[offsets[r] : offsets[r + 1]].copy()))
        if held:
            yield links()

    return stage(map_batches(rows, run, "a long, b long").distinct(), "heavy-links")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles and component_id.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Documents with 100 * intersection >= percent * union of their distinct
    k-word shingles link; component_id is the least doc_id reachable by links, the document itself included. Defined
    results: null, empty and wordless texts have no shingles and link with nothing; texts of fewer than k words have one
    shingle; rows with a null doc_id take no part and get a null component; rows that share a doc_id are one node;
    other columns are not read. Shingles are compared by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = common_grams(docs, k)
    rows = stage(document_rows(docs, k, percent, common), "rows")
    # rows of one set: the least id stands for all; equal sets have equal prefixes
    real = rows.where("n > 0 and doc_id is not null")
    sets = stage(real.groupBy("sign").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "sets")
    members = real.select("doc_id", "sign").join(sets.select("sign", "id"), "sign").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    fit = (F.lit(percent) * F.greatest("na", "nb") <= F.lit(100) * F.least("na", "nb")) & (F.col("a") != F.col("b"))
    # behind the prefix that ends first nothing is known; either may end first, so the larger rest, ceil(t n) - 1, is allowed for
    rest = F.ceil(F.lit(percent) * F.greatest("na", "nb") / F.lit(100)) - 1

    def summed(met: DataFrame) -> DataFrame:
        """Pairs whose overlap counts over the columns, with what may follow, reach what their sizes demand."""
        counts = met.groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("c"))
        return counts.where(F.col("c") + rest >= _needed(percent, "na", "nb")).select("a", "na", "b", "nb")

    # columns of two documents or more, each with its leader
    postings = sets.select("id", "n", F.explode("prefix").alias("gram"))
    columns = postings.groupBy("gram").agg(F.min(F.struct("id", "n")).alias("lead"), F.count(F.lit(1)).alias("held")).where("held > 1")
    block = stage(postings.join(columns, "gram"), "postings")

    # 1. the rows of the product for the leaders
    near = block.select(F.col("lead.id").alias("a"), F.col("lead.n").alias("na"), F.col("id").alias("b"), F.col("n").alias("nb")).where(fit)
    first = _verified(docs, stage(summed(near), "leaders"), k, percent, "leaders")
    label = first.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label"))
    block = block.select("gram", "id", "n", "held").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))

    # 2. the rest of the blocked product, between labels
    shared = block.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gram")
    block = stage(block.join(shared, "gram"), "labelled")
    third = _heavy_links(docs, block.where(F.col("held") > HEAVY).drop("held"), k, percent)
    # a pair that shares a heavy column is decided above; all columns of any other pair are light
    block = block.where(F.col("held") <= HEAVY)
    one = block.select(F.col("gram"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    two = block.select(F.col("gram"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    met = one.join(two, "gram").where((F.col("la") != F.col("lb")) & (F.col("a") < F.col("b")) & fit)
    second = _verified(docs, stage(summed(met), "likely"), k, percent, "likely")

    links = members.union(first).union(second)
    nodes = components(links if third is None else links.union(third))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
