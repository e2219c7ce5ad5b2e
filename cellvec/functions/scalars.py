"""Column functions on tags: values, levels, heights. A missing tag is null or an empty string."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TALL_LEVELS, TALL_METRES = 6, 20
FOOT = 0.3048


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used: written out, code grows with every use of a use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tag(key: str) -> Column:
    return F.nullif(F.try_element_at(F.col("tags"), F.lit(key)), F.lit(""))


def tag_in(key: str, values: Iterable[str]) -> Column:
    return F.coalesce(tag(key).isin(*values), F.lit(False))


def has_tag(key: str) -> Column:
    return tag(key).isNotNull()


def number(text: Column) -> Column:
    """A plain decimal number, else null."""
    return let(F.trim(text), lambda t: F.when(t.rlike(NUMBER), t.try_cast("double")))


def levels(text: Column) -> Column:
    """Floors: the text before the first ';', commas as points."""
    return number(F.replace(F.get(F.split(text, ";"), F.lit(0)), F.lit(","), F.lit(".")))


def height_m(text: Column) -> Column:
    """Metres, from metres or feet; inches don't count."""
    def metres(t: Column) -> Column:
        feet = F.contains(t, F.lit("'")) | F.contains(t, F.lit("ft"))
        in_feet = number(F.replace(F.get(F.split(t, "'"), F.lit(0)), F.lit("ft"), F.lit(""))) * FOOT
        return F.when(feet, in_feet).otherwise(levels(t))

    without = lambda t: F.when(t.endswith("m"), F.trim(F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(t)
    return let(F.trim(F.lower(text)), lambda t: let(without(t), metres))


def is_tall() -> Column:
    tall = lambda key, height, least: F.when(F.coalesce(F.map_contains_key("tags", key), F.lit(False)), F.coalesce(height(tag(key)) >= least, F.lit(False))).otherwise(F.lit(False))
    return tall("building:levels", levels, TALL_LEVELS) | tall("height", height_m, TALL_METRES)


def land_use_class(rules: dict[str, dict[str, list[str]]]) -> Column:
    """The first class of which a rule matches; null if none does."""
    out = None
    for name, tags in rules.items():
        hit = F.lit(False)
        for key, values in tags.items():
            hit = hit | tag_in(key, values)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out
