"""The operators bound to the driver's tables: queries and their DuckDB SQL."""

from __future__ import annotations

from quarrylight.ship import ship

from . import (
    op1_token_file,
    op10_jaccard_join,
    op2_quality,
    op3_language_id,
    op4_exact_dedup,
    op5_byte_bpe,
    op6_line_dedup,
    op7_pii,
    op8_sharding,
    op9_packing,
)

MODULES = {
    "op1_token_file": op1_token_file,
    "op2_quality": op2_quality,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_pii": op7_pii,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_jaccard_join": op10_jaccard_join,
}


def shipped(query):
    """The query, with the package's sources sent to the executors first."""

    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: shipped(m.query) for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE for name, m in MODULES.items() if m.ORACLE}
