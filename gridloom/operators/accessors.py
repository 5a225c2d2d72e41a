"""Steps for ``DataFrame.transform``: tables that say where their blocks are become models on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from gridloom.functions.geometry import Geometry
from gridloom.operators import mesh
from gridloom.operators.model import BlockModel
from gridloom.plans.schema import BlockSchema

Step = Callable[[DataFrame], DataFrame]


def as_blocks(geometry: Geometry | None = None, schema: BlockSchema | None = None, **angles: float) -> Step:
    """The canonical table of a model; without a geometry, inferred from x, y and z."""
    return lambda df: _model(df, geometry, schema, angles).df


def stored(path: str, geometry: Geometry | None = None, schema: BlockSchema | None = None, overwrite: bool = False, **angles: float) -> Step:
    """Store the model and go on with what was stored."""
    from gridloom.sources import store

    return lambda df: store.save(_model(df, geometry, schema, angles), path, overwrite=overwrite).df


def as_grid(columns: list[str], geometry: Geometry | None = None, **angles: float) -> Step:
    """The dense grid with x fastest, as grid files hold it: cell, i, j, k and the columns."""
    return lambda df: mesh.grid_table(_model(df, geometry, None, angles), columns)


def _model(df: DataFrame, geometry: Geometry | None, schema: BlockSchema | None, angles: dict[str, float]) -> BlockModel:
    from gridloom.sources import store

    return store.ingest(df, geometry, schema, **angles)
