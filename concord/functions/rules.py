"""Name lookups and ordered keyword rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions import fixed_values as fixed


def literal_map(mapping: Mapping) -> Column:
    """A small Python mapping as a map literal, looked up without any join."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def lookup(key: Column, mapping: Mapping, default=None) -> Column:
    """Value of ``key``; ``default`` (a value or a Column) where it is unknown."""
    found = F.try_element_at(literal_map(mapping), key)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def normalise_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[-_]", "")


def lookup_normalised(key: Column, mapping: Mapping[str, str]) -> Column:
    """Exact lower-case key first, then the key without ``-`` and ``_``, then the key itself.

    Where two entries normalise to one key the first entry counts.
    """
    folded: dict[str, str] = {}
    for name, value in mapping.items():
        folded.setdefault(name.replace("-", "").replace("_", ""), value)
    lowered = F.lower(key)
    return F.coalesce(lookup(lowered, mapping), lookup(normalise_key(key), folded), lowered)


def keyword_family(
    name: Column,
    families: Mapping[str, Sequence[str]] = fixed.FAMILY_KEYWORDS,
    default: str = "Other",
) -> Column:
    """First family, in declared order, with a keyword inside the lower-case name."""
    lowered = F.lower(name)
    return F.coalesce(
        *[F.when(_any_contains([lowered], words), F.lit(family)) for family, words in families.items()],
        F.lit(default),
    )


def rule_label(
    name: Column,
    config: Column,
    rules: Sequence[tuple[str, str]] = tuple(fixed.MODEL_TYPE_RULES),
    json_paths: Sequence[str] = tuple(fixed.MODEL_TYPE_PATHS),
    default: str = "unknown",
) -> Column:
    """Label by the first rule met by the name, else by the first met by the JSON config."""
    texts = [F.lower(F.coalesce(F.get_json_object(config, path), F.lit(""))) for path in json_paths]
    lowered = F.lower(name)
    by_name = [F.when(_any_contains([lowered], [word]), F.lit(label)) for word, label in rules]
    by_config = [F.when(_any_contains(texts, [word]), F.lit(label)) for word, label in rules]
    return F.coalesce(*by_name, *by_config, F.lit(default))


def _any_contains(texts: Sequence[Column], words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for text in texts:
        for word in words:
            hit = hit | text.contains(word)
    return hit
