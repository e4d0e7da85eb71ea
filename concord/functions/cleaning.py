"""Cleaning of predictions, text and numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions import fixed_values as fixed


def null_errors(label: Column, mark: str = fixed.ERROR_MARK) -> Column:
    """Null for any label that contains the error mark."""
    return F.when(~label.contains(mark), label)


def null_exact(label: Column, sentinel: str) -> Column:
    """Null for one exact sentinel."""
    return F.nullif(label, F.lit(sentinel))


def strip_text(text: Column) -> Column:
    """Trim every kind of white space, not only blanks, at both ends."""
    return F.btrim(text, F.lit("".join(map(chr, fixed.WHITE_SPACE_CODES))))


def to_number(text: Column, missing: Sequence[str] = tuple(fixed.MISSING_NUMBER_MARKS)) -> Column:
    """Text as double; unreadable text and missing marks become null."""
    return F.when(~text.isin(*missing), text).try_cast("double")


def safe_ratio(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """``numerator / denominator`` where the denominator is positive, else ``default``."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(default).cast("double"))


def eps_ratio(numerator: Column, denominator: Column, eps: float = fixed.EPSILON) -> Column:
    """``numerator / (denominator + eps)``."""
    return numerator / (denominator + F.lit(eps))


def to_millions(count: Column) -> Column:
    return count / F.lit(1e6)


def to_mebibytes(size: Column) -> Column:
    return size / F.lit(float(1024**2))


def to_millis(seconds: Column) -> Column:
    return seconds * F.lit(1000.0)


def per_second(millis: Column) -> Column:
    """Throughput of one-at-a-time work that takes ``millis`` each."""
    return safe_ratio(F.lit(1000.0), millis)


def mean_std_text(mean: Column, std: Column, digits: int = 2) -> Column:
    """``mean ± std`` as text."""
    return F.format_string(f"%.{digits}f ± %.{digits}f", mean, std)


def short_label(label: Column, length: int = 25) -> Column:
    return F.substring(label, 1, length)


def safe_name(number: Column, title: Column, length: int = 60) -> Column:
    """``NN_title`` with every char but letters, digits, blank, ``_`` and ``-`` replaced."""
    clean = F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "_")
    return F.concat(F.format_string("%02d", number), F.lit("_"), F.substring(clean, 1, length))
