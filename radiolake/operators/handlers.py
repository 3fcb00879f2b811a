"""Default per-protocol steps, each a DataFrame -> DataFrame function.

``registry.run_handler(df, step)`` applies them; replacing an entry of a protocol's
``handlers`` changes that protocol only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from radiolake.functions.fields import field
from radiolake.operators.dedup import deduplicate_pdus
from radiolake.operators.sessions import stable_color
from radiolake.registry import PROTOCOLS


def keep_stable_color(scope: list[str]):
    """dPMR rows of the dominant colour of their scope."""

    def step(df: DataFrame) -> DataFrame:
        flat = df.withColumns(
            {
                "color_code": field(df, "extra.color_code", "bigint"),
                "confidence": field(df, "extra.confidence", "string"),
            }
        )
        out = stable_color(flat, scope)
        return out.drop("color_code", "confidence")

    return step


def install_defaults(scope: list[str]) -> None:
    for p in PROTOCOLS.values():
        p.handlers["dedup"] = lambda df: deduplicate_pdus(df, scope)
        p.handlers["postprocess"] = lambda df: df
    PROTOCOLS["dPMR"].handlers["postprocess"] = keep_stable_color(scope)


