"""Relations with why-provenance: each row knows the tokens of the base rows it was joined from.

Joins append token columns in the order of the relations; selections leave them alone; grouping collects one witness (the list of
tokens) per contributing row into a bag; a window over groups leaves bags alone; rows cut by a top-k lose theirs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """A DataFrame and its token columns, one per base relation, in FROM order."""

    df: DataFrame
    tokens: tuple[str, ...]

    @staticmethod
    def base(df: DataFrame, name: str, prov: str = "prov") -> Relation:
        """A base table under an alias; the same table may be used under several."""
        token = f"__token_{name}"
        return Relation(df.withColumnRenamed(prov, token).alias(name), (token,))

    def where(self, condition: Column) -> Relation:
        return Relation(self.df.where(condition), self.tokens)

    def join(self, other: Relation, condition: Column) -> Relation:
        """Inner join; the other relation's tokens come after this one's."""
        return Relation(self.df.join(other.df, condition), self.tokens + other.tokens)

    def in_order(self, *names: str) -> Relation:
        """The same rows, with tokens in the order of these relations: joins may be made in another order than FROM lists them."""
        return Relation(self.df, tuple(f"__token_{n}" for n in names))

    @property
    def witness(self) -> Column:
        return F.array(*[F.col(t) for t in self.tokens])

    def project(self, *columns: Column) -> DataFrame:
        """Row level: one witness a row, equal rows are not merged."""
        return self.df.select(*columns, self.witness.alias("prov"))

    def group(self, keys: list[Column], *values: Column) -> DataFrame:
        return self.df.groupBy(*keys).agg(*values, F.collect_list(self.witness).alias("prov"))

    def total(self, *values: Column) -> DataFrame:
        """One row; over no rows the bag is null, as an SQL list aggregate is."""
        return self.df.agg(*values, F.when(F.count(F.lit(1)) > 0, F.collect_list(self.witness)).alias("prov"))

    def digest(self, keys: list[Column], *values: Column) -> DataFrame:
        """Groups with the number of their witnesses and an order-free digest in place of the bag, for groups of any size: a bag is one
        row of one task, a digest is summed where the rows are. Over no rows and without keys, the digest is null."""
        return self.df.groupBy(*keys).agg(*values, F.count(F.lit(1)).alias("n_witnesses"), F.sum(digest_of(self.witness)).alias("witness_digest"))

    def rollup(self, keys: list[str], averages: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
        """ROLLUP over keys (columns of these names), with averages, bags and `level` (the number of keys rolled up), for each
        combination of the columns `by`.

        The joined rows are grouped once, at the finest level; coarser levels sum the groups' sums and counts and
        flatten their bags, so no witness is copied before it is collected. The total exists over no rows too, with null values, where
        there are no columns `by`.
        """
        parts = [f(c).alias(f"__{k}_{n}") for n, c in averages.items() for k, f in (("sum", F.sum), ("n", F.count))]
        every = [*by, *keys]
        finest = self.df.groupBy(*[F.col(k) for k in every]).agg(*parts, F.collect_list(self.witness).alias("__bag"))
        values = [(F.sum(f"__sum_{n}").cast("double") / F.nullif(F.sum(f"__n_{n}"), F.lit(0))).alias(n) for n in averages]
        bag = F.flatten(F.collect_list("__bag"))
        level = F.bit_count("__gid").cast("int").alias("level")
        if by:
            sets = [[*by, *keys[:k]] for k in range(len(keys), -1, -1)]
            rolled = finest.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(*values, bag.alias("prov"), F.grouping_id().alias("__gid"))
            return rolled.select(*every, *averages, "prov", level)
        rolled = finest.rollup(*keys).agg(*values, bag.alias("prov"), F.grouping_id().alias("__gid"))
        names = [*averages, "prov"]
        grand = finest.agg(*values, F.when(F.count(F.lit(1)) > 0, bag).alias("prov"))
        types = {f.name: f.dataType for f in finest.schema}
        grand = grand.select(*[F.lit(None).cast(types[k]).alias(k) for k in keys], *names, F.lit(len(keys)).alias("level"))
        return rolled.where(F.col("__gid") < (1 << len(keys)) - 1).select(*keys, *names, level).union(grand)


def digest_of(witness: Column) -> Column:
    """60 bits of the md5 of a witness (tokens joined by a bar), as a number that any database can sum."""
    return F.conv(F.substring(F.md5(F.array_join(witness, "|")), 1, 15), 16, 10).cast("decimal(38,0)")


def either(arms: list[Column]) -> Column:
    """A disjunction; the optimizer draws out what all arms share."""
    return reduce(lambda a, b: a | b, arms)


def share(df: DataFrame, value: str, partition: list[str], factor: float, name: str) -> DataFrame:
    """value * factor / total of value over the partition, as double; over a total of zero the IEEE result."""
    top = F.col(value).cast("double") * F.lit(float(factor))
    whole = F.sum(value).over(Window.partitionBy(*partition)).cast("double")
    special = F.when(top > 0, F.lit(float("inf"))).when(top < 0, F.lit(float("-inf"))).otherwise(F.when(top.isNull(), None).otherwise(F.lit(float("nan"))))
    return df.withColumn(name, F.when(whole != 0, top / whole).when(whole == 0, special))


def top(df: DataFrame, keys: list[str], n: int | None = 100) -> DataFrame:
    """Rows in ascending order of the keys, nulls last; the first n."""
    ordered = df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])
    return ordered if n is None else ordered.limit(n)


def leading(df: DataFrame, by: list[Column | str], keys: list[Column], n: int) -> DataFrame:
    """The rows of each group (of equal `by`) before which fewer than n of the group come in the order of the keys: the first n, and what
    ties with the last of them. Tasks cut their own rows before they are shuffled."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(*keys))
    return df.withColumn("__leading", rank).where(F.col("__leading") <= n).drop("__leading")


def first_matches(left: Relation, right: Relation, condition: Column, key: str, first: Column, n: int, by: tuple[str, ...] = ()) -> Relation:
    """The rows of left.join(right, condition) that can be among the first n in the order of `first` and then of the witnesses (of each
    combination of the columns `by`), for a limit that follows; condition compares the column `key` of right with columns of left.

    Of the rows of right with one key only the first n by token can be, for each row of left; and of the rows of left that meet any,
    the first n, as each makes a row at least. So no more than n * n rows are made, however many match."""
    right = Relation(leading(right.df, [key], [F.col(t).asc() for t in right.tokens], n), right.tokens)
    meet = left.df.join(right.df.select(key).distinct(), condition, "left_semi")
    return Relation(leading(meet, list(by), [first.asc_nulls_last(), left.witness.asc()], n), left.tokens).join(right, condition)


def average(value: Column | str) -> Column:
    """AVG as double: the exact sum divided by the count."""
    return F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0))
