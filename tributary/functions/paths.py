"""Column expressions over model file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layer folders, in order of priority.
LAYERS = ("staging", "intermediate", "marts")


def _segments(path: Column) -> Column:
    return F.split(path, "/")


def layer_of(path: Column) -> Column:
    """First of the known layers that occurs as a path segment, else ``unknown``."""
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for layer in LAYERS:
        rule = rule.when(F.array_contains(_segments(path), layer), F.lit(layer))
    return rule.otherwise(F.lit("unknown"))


def group_of(path: Column) -> Column:
    """Domain folder in front of the first layer folder; null when there is none."""
    segments = _segments(path)
    spots = F.array(*[F.array_position(segments, layer) for layer in LAYERS])
    first_layer = F.array_min(F.filter(spots, lambda spot: spot > 0))
    return F.when(first_layer > 2, F.element_at(segments, 2))


def stem_of(path: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_replace(F.element_at(_segments(path), -1), r"(?<=.)\.[^.]*$", "")
