"""A table's own columns beside those that an operator adds."""

from __future__ import annotations

from pyspark.sql import DataFrame


def set_aside(table: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns of these names, in any case, under names that nothing else has; and how to name them back."""
    taken, own = {n.lower() for n in names}, {c.lower() for c in table.columns}
    away, number = {}, 0
    for column in table.columns:
        if column.lower() in taken:
            while f"_own{number}" in own | taken:
                number += 1
            away[column] = f"_own{number}"
            own.add(f"_own{number}")
    return table.withColumnsRenamed(away), {new: old for old, new in away.items()}
