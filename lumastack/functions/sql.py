"""SQL names for operators that are expressions of columns, and table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumastack.operators.grids import AP_GRID_TYPE, ApGrid

#: name(parameters), type and body of each function.
FUNCTIONS = {
    "raw_score(lap DOUBLE, ten DOUBLE, nv DOUBLE)": ("DOUBLE", "0.5 * lap + 0.3 * ten + 0.2 * nv"),
    "luminance(r DOUBLE, g DOUBLE, b DOUBLE)": ("DOUBLE", "0.2126 * r + 0.7152 * g + 0.0722 * b"),
    "rotation_delta(dt DOUBLE, period_hours DOUBLE)": ("DOUBLE", "dt / (period_hours * 3600) * 360"),
    "levels_adjust(v DOUBLE, black DOUBLE, white DOUBLE, gamma DOUBLE)": ("DOUBLE", "power(greatest(0D, least(1D, (v - black) / greatest(white - black, 1e-6D))), 1 / gamma)"),
    "soft_threshold(v DOUBLE, t DOUBLE)": ("DOUBLE", "signum(v) * greatest(abs(v) - t, 0D)"),
    "trusted_shift(conf DOUBLE, dx DOUBLE, dy DOUBLE)": ("BOOLEAN", "conf >= 0.15 AND sqrt(dx * dx + dy * dy) <= 20"),
    "residual_shift(dt DOUBLE, scale DOUBLE, rate DOUBLE, radius DOUBLE)": ("DOUBLE", "CASE WHEN abs(dt) > 0.5 THEN (1 - scale) * dt * rate * radius ELSE 0D END"),
}


def register_functions(spark: SparkSession) -> None:
    """Make the functions, and the table function ap_grid, known to SQL in this session."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("ap_grid", F.arrow_udtf(ApGrid, returnType=AP_GRID_TYPE))
