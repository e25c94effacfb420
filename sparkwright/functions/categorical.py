"""Category encoding by rank of frequency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE = "rare_label"


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n in falling order of n; ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


@dataclass(frozen=True)
class Categories:
    """The `most` frequent values get ids in order of rank, from 1 (targets: from 0); every other value the next id after them."""

    values: tuple[str, ...]
    first: int = 1

    @classmethod
    def fit(cls, df: DataFrame, column: str, most: int = 15, for_target: bool = False) -> Categories:
        top = category_counts(df, column).limit(most)  # a top-k: bounded by `most`
        return cls(tuple(r["value"] for r in top.collect()), 0 if for_target else 1)

    @property
    def rare(self) -> int:
        return len(self.values) + self.first

    def encode(self, value: Column) -> Column:
        """Null stays null."""
        at = F.array_position(F.array(*[F.lit(v) for v in self.values]), value) if self.values else F.lit(0)
        return F.when(value.isNull(), None).when(at > 0, at - 1 + self.first).otherwise(self.rare).cast("int")

    def inverse(self, code: Column) -> Column:
        at = code - (self.first - 1)
        known = F.element_at(F.array(*[F.lit(v) for v in self.values]), at.cast("int")) if self.values else F.lit(RARE)
        return F.when(code.isNull(), None).when((at >= 1) & (at <= len(self.values)), known).otherwise(F.lit(RARE))


def one_hot(code: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == code).cast("int"))


def multi_hot(codes: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.array_contains(codes, i).cast("int"))


def arg_max(values: Column) -> Column:
    """Position of the largest value, from 0; the first one of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def round_labels(values: Column) -> Column:
    return F.transform(values, lambda x: F.rint(x).cast("int"))
