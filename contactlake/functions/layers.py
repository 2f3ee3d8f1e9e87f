"""Layered column recipes.

A cleaner needs intermediate values (the trimmed text, the digits, the
domain) several times. Nesting them in one expression would repeat the work,
so a cleaner is a list of *layers*: each layer is ``{column name: Column}``
and may use the columns of the layers before it.

The layers of one recipe are small projections that Spark fuses into one
generated method. The JVM only compiles methods of limited size, so recipes
follow each other: each starts with its Unicode composition, the one step that
is a call and not generated code, and is thereby generated on its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

Layer = dict[str, Column]


@dataclass(frozen=True)
class Recipe:
    layers: list[Layer]
    prepare: Layer = field(default_factory=dict)
    compose: Layer = field(default_factory=dict)


def apply_layers(df: DataFrame, *recipes: Recipe | tuple[Recipe, ...]) -> DataFrame:
    """Apply recipes one after the other; a tuple is laid side by side."""
    for group in recipes:
        members = group if isinstance(group, tuple) else (group,)
        for step in ("prepare", "compose"):
            merged: Layer = {}
            for recipe in members:
                merged.update(getattr(recipe, step))
            if merged:
                df = df.withColumns(merged)
        for depth in range(max(len(r.layers) for r in members)):
            merged = {}
            for recipe in members:
                if depth < len(recipe.layers):
                    merged.update(recipe.layers[depth])
            df = df.withColumns(merged)
    return df
