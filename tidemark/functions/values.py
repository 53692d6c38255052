"""How a raw value becomes a number to bin or a category to count."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Labels of the missing category, of the remaining ones, and of the bin without a number.
MISSING = "__MISSING__"
OTHER = "__OTHER__"
NO_NUMBER_BIN = -1

# What a key of a distribution stands for. Kept beside the label, because a text column may
# hold the label itself as an ordinary value.
BIN, VALUE, ABSENT, REST = "bin", "value", "missing", "other"


def quoted(name: str) -> str:
    """The exact column name, dots and backticks included, as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def number(name: str) -> Column:
    """The value as a double; adding zero turns -0.0 into 0.0, so both fall into the same bin."""
    return F.expr(f"CAST({quoted(name)} AS DOUBLE) + 0D")


def without_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def category(name: str) -> Column:
    """The value as text; null stays null, see key_label."""
    return column(name).cast("string")


def key_label(kind: Column, key: Column) -> Column:
    return F.when(kind == ABSENT, F.lit(MISSING)).when(kind == REST, F.lit(OTHER)).otherwise(key)


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, null where there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
