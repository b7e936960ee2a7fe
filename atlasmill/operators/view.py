"""Point queries over the output tables, each a filtered select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colors import default_color
from ..functions.scalars import natural_sort_key, standardize_missing
from .ordering import one_row, with_position


class AtlasView:
    """Annotations, projections and their metadata as three lazily read tables."""

    def __init__(self, annotations: DataFrame, metadata: DataFrame, data: DataFrame, state: dict | None = None):
        # the first column identifies the row whatever it is called
        self.annotations = annotations.withColumnRenamed(annotations.columns[0], "identifier")
        self.metadata, self.data = metadata, data
        self.state = state or {"annotation_colors": {}, "marker_shapes": {}}

    def projection_names(self) -> list[str]:
        return [r[0] for r in self.metadata.select("projection_name").distinct().orderBy("projection_name").collect()]

    def annotation_names(self) -> list[str]:
        return self.annotations.columns[1:]

    def ids(self) -> DataFrame:
        return self.annotations.select("identifier")

    def projection_info(self, name: str) -> dict:
        row = self.metadata.filter(F.col("projection_name") == name).first()
        if row is None:
            raise ValueError(f"Projection {name} not found")
        return row.asDict()

    def is_3d(self, name: str) -> bool:
        return self.projection_info(name)["dimensions"] == 3

    def projection_data(self, name: str) -> DataFrame:
        self.projection_info(name)
        return self.data.filter(F.col("projection_name") == name)

    def annotations_of(self, identifier: str) -> dict:
        row = self.annotations.filter(F.col("identifier") == identifier).first()
        return {} if row is None else {k: v for k, v in row.asDict().items() if k != "identifier"}

    def values(self, annotation: str) -> DataFrame:
        return self.annotations.select(F.col(annotation).alias("value"))

    def distinct_values(self, annotation: str) -> DataFrame:
        return self.values(annotation).distinct()

    def colors(self, annotation: str) -> dict:
        return self.state["annotation_colors"].get(annotation, {})

    def shapes(self, annotation: str) -> dict:
        return self.state["marker_shapes"].get(annotation, {})

    def with_color(self, annotation: str, value: str, color: str) -> AtlasView:
        return self._restyled("annotation_colors", annotation, value, color)

    def with_shape(self, annotation: str, value: str, shape: str) -> AtlasView:
        return self._restyled("marker_shapes", annotation, value, shape)

    def _restyled(self, part: str, annotation: str, value: str, what: str) -> AtlasView:
        state = {p: {a: dict(v) for a, v in m.items()} for p, m in self.state.items()}
        state[part].setdefault(annotation, {})[value] = what
        return AtlasView(self.annotations, self.metadata, self.data, state)

    def plot_frame(self, projection: str, annotation: str) -> DataFrame:
        return plot_frame(self.projection_data(projection), self.annotations, annotation)


def plot_frame(points: DataFrame, annotations: DataFrame, annotation: str, id_col: str = "identifier") -> DataFrame:
    """Coordinates with one annotation, missing values shown as <N/A>."""
    one = annotations.select(id_col, F.col(annotation).alias("_a"))
    return points.join(one, id_col, "left").withColumn(annotation, standardize_missing("_a")).drop("_a")


def category_legend(frame: DataFrame, annotation: str) -> DataFrame:
    """Distinct values in natural order with evenly spaced default colours."""
    values = frame.select(F.col(annotation).alias("value")).distinct().withColumn("_k", natural_sort_key("value"))
    placed = with_position(values, ["_k", "value"], "position").drop("_k")
    total = one_row(placed.agg(F.count("*").alias("n")))["n"]
    return placed.select(
        "value", F.col("position").cast("int").alias("position"), default_color("position", total).alias("color")
    )


def highlight(points: DataFrame, selected: list[str], id_col: str = "identifier") -> DataFrame:
    return points.filter(F.col(id_col).isin(selected))


def bounding_box(points: DataFrame, dims: int = 3, margin: float = 1.05) -> DataFrame:
    cols: list[Column] = []
    for c in ["x", "y", "z"][:dims]:
        cols += [(F.min(c) * F.lit(margin)).alias(f"{c}_min"), (F.max(c) * F.lit(margin)).alias(f"{c}_max")]
    return points.agg(*cols)


def coordinate_range(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")
    )
