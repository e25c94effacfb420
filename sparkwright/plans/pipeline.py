"""A feature pipeline: encoders over columns, fitted by as few scans as possible, applied as one projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chrono
from ..functions.categorical import Categories
from ..functions.numeric import MinMax, Standard, finite


@dataclass
class Node:
    name: str
    kind: str
    column: str
    options: dict = field(default_factory=dict)
    fitted: object = None

    @property
    def outputs(self) -> list[str]:
        return [f"{self.name}_sin", f"{self.name}_cos"] if self.kind == "cycle" else [self.name]

    def encode(self) -> list[Column]:
        c = F.col(self.column)
        if self.kind == "cycle":
            return [x.alias(n) for x, n in zip(chrono.cycle(c, self.options["part"], self.options["whole"]), self.outputs, strict=True)]
        return [self.fitted.encode(c).alias(self.name)]

    def decode(self) -> list[Column]:
        """The source column again; a cycle gives its share of the whole."""
        if self.kind == "cycle":
            return [chrono.cycle_angle(*map(F.col, self.outputs)).alias(f"{self.name}_share")]
        return [self.fitted.inverse(F.col(self.name)).alias(self.column)]


class FeaturePipeline:
    """Nodes in the order in which they were connected; names and outputs are unique.

    fit() takes the numbers of all numeric nodes from one aggregate; each category node costs one top-k.
    """

    def __init__(self):
        self.nodes: list[Node] = []

    def connect(self, kind: str, column: str, name: str | None = None, **options) -> FeaturePipeline:
        node = Node(name or f"{column}_{kind}", kind, column, options)
        clash = {o for n in self.nodes for o in n.outputs} & set(node.outputs)
        if clash:
            raise ValueError(f"output names are taken: {sorted(clash)}")
        self.nodes.append(node)
        return self

    def min_max(self, column: str, name: str | None = None) -> FeaturePipeline:
        return self.connect("min_max", column, name)

    def standard(self, column: str, name: str | None = None) -> FeaturePipeline:
        return self.connect("standard", column, name)

    def categories(self, column: str, name: str | None = None, most: int = 15, for_target: bool = False) -> FeaturePipeline:
        return self.connect("categories", column, name, most=most, for_target=for_target)

    def cycle(self, column: str, part: str, whole: str, name: str | None = None) -> FeaturePipeline:
        if (part, whole) not in chrono.RATIOS:
            raise ValueError(f"no cycle of {part} in {whole}")
        return self.connect("cycle", column, name or f"{part}_{whole}", part=part, whole=whole)

    def fit(self, df: DataFrame, unfitted_only: bool = False) -> FeaturePipeline:
        if problems := self.missing(df):
            raise ValueError(f"missing columns: {problems}")
        todo = [n for n in self.nodes if n.kind != "cycle" and not (unfitted_only and n.fitted)]
        numeric = [n for n in todo if n.kind in ("min_max", "standard")]
        wanted = []
        for i, n in enumerate(numeric):
            c = finite(n.column)
            wanted += [F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")] if n.kind == "min_max" else [F.avg(c).alias(f"a{i}"), F.stddev_pop(c).alias(f"b{i}")]
        if wanted:
            row = df.agg(*wanted).first()
            for i, n in enumerate(numeric):
                n.fitted = (MinMax if n.kind == "min_max" else Standard)(row[f"a{i}"], row[f"b{i}"])
        for n in todo:
            if n.kind == "categories":
                n.fitted = Categories.fit(df, n.column, **n.options)
        return self

    @property
    def is_fitted(self) -> bool:
        return all(n.fitted or n.kind == "cycle" for n in self.nodes)

    def encode(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        return df.select(*(keep or []), *[c for n in self.nodes for c in n.encode()])

    def decode(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        there = set(df.columns)
        return df.select(*(keep or []), *[c for n in self.nodes if there.issuperset(n.outputs) for c in n.decode()])

    def missing(self, df: DataFrame) -> list[str]:
        return sorted({n.column for n in self.nodes} - set(df.columns))

    def layout(self) -> list[tuple[str, int, int]]:
        """(node, first output, outputs) in the encoded table."""
        out, at = [], 0
        for n in self.nodes:
            out.append((n.name, at, len(n.outputs)))
            at += len(n.outputs)
        return out

    def output_types(self) -> dict[str, str]:
        return {o: n.kind for n in self.nodes for o in n.outputs}

    def category_outputs(self) -> dict[int, int]:
        """Position of each category output -> number of codes, the rare one included."""
        return {at: len(n.fitted.values) + 1 for n, (_, at, _) in zip(self.nodes, self.layout(), strict=True) if n.kind == "categories" and n.fitted}

    def numeric_outputs(self) -> list[int]:
        return [at + i for n, (_, at, width) in zip(self.nodes, self.layout(), strict=True) if n.kind != "categories" for i in range(width)]

    def validate(self, df: DataFrame | None = None) -> list[str]:
        problems = [f"{n.name} is not fitted" for n in self.nodes if n.kind != "cycle" and not n.fitted]
        return problems + ([f"column {c} is missing" for c in self.missing(df)] if df is not None else [])


def expand_arrays(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Array columns as one column for each position: name_0, name_1, ..."""
    cols = []
    for c in df.columns:
        cols += [F.get(F.col(c), F.lit(i)).alias(f"{c}_{i}") for i in range(widths[c])] if c in widths else [F.col(c)]
    return df.select(*cols)


def to_matrix(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns]))
