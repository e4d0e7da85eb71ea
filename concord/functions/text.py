"""Names and values inside SQL expression text.

A loop over voters that builds Column objects costs several calls into the JVM
per voter and operand; one expression text per voter costs a single call.
"""

from __future__ import annotations


def name(column: str) -> str:
    """A column name, quoted."""
    return "`" + column.replace("`", "``") + "`"


def literal(value: object) -> str:
    """A Python string, number or boolean as a SQL literal."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def struct(**fields: str) -> str:
    """A struct of the given expressions."""
    return "named_struct(" + ", ".join(f"{literal(k)}, {v}" for k, v in fields.items()) + ")"
