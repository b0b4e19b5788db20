"""Cells in Spark SQL: temporary functions of a session, which the optimizer puts in place of their calls.

| function | result |
| --- | --- |
| ``cell_parent(cell, levels)`` | the ancestor so many levels up |
| ``cell_zuniq(cell, level)``, ``zuniq_level(z)``, ``zuniq_cell(z)`` | numbers that hold level and cell |
| ``cell_resolution(metres)`` | the level of nearest cell size |
| ``cell_children(cell, levels)`` | table of child_id, for ``from orders, lateral cell_children(cell_id, 1)`` |

Null arguments give nulls; ``cell_children`` gives no rows then. No Python runs for a row. What
takes many steps (centres, neighbours, cells of places) stays with the frames of ``cells``: a SQL
function is put into one expression, in which each step would repeat those before it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import cells as C

_SIZE = "shiftleft(1L, 2 * levels)"
#: Signature and body of each function.
FUNCTIONS = {
    "cell_parent(cell BIGINT, levels INT) RETURNS BIGINT": "shiftright(cell, 2 * levels)",
    "cell_zuniq(cell BIGINT, level INT) RETURNS BIGINT": f"shiftleft(2 * cell + 1, 2 * ({C.MAX_LEVEL} - level))",
    "zuniq_level(z BIGINT) RETURNS INT": C.zuniq_level("z"),
    "zuniq_cell(z BIGINT) RETURNS BIGINT": f"shiftright(z, 2 * ({C.MAX_LEVEL} - {C.zuniq_level('z')}) + 1)",
    "cell_resolution(metres DOUBLE) RETURNS INT": C.resolution_level_sql("metres"),
    "cell_children(cell BIGINT, levels INT) RETURNS TABLE(child_id BIGINT)": f"SELECT explode(sequence(cell * {_SIZE}, cell * {_SIZE} + {_SIZE} - 1))",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [signature.partition("(")[0] for signature in FUNCTIONS]
