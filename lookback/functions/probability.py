"""Reading recorded probability answers: arrays of labels and of their probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def answer(answers: Column, key: str) -> Column:
    """The first answer with a key; null if there is none."""
    return F.try_element_at(F.filter(answers, lambda a: a["key"] == key), F.lit(1))


def required_answer(answers: Column, key: str) -> Column:
    """The first answer with a key; the query fails where there is none."""
    found = answer(answers, key)
    return F.when(found.isNull(), F.raise_error(F.lit(f"no answer to {key}"))).otherwise(found)


def expected_position(p: Column) -> Column:
    """Mean place among the levels, from 0 to 1."""
    weighted = F.aggregate(F.zip_with(p, F.sequence(F.lit(0), F.size(p) - 1), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(p) > 1, weighted / (F.size(p) - 1)).when(F.size(p) == 1, F.lit(0.0))


def option_probability(labels: Column, p: Column, option: str) -> Column:
    place = F.array_position(labels, option)
    return F.when(place > 0, F.try_element_at(p, place.cast("int")))


def likeliest_option(labels: Column, p: Column) -> Column:
    """The option of the greatest probability, the first of ties."""
    return F.try_element_at(labels, F.array_position(p, F.array_max(p)).cast("int"))


def certainty(*readings: Column) -> Column:
    """The least certainty of several readings, 0 without any. Nulls don't count."""
    return F.coalesce(F.array_min(F.filter(F.array(*readings), lambda x: x.isNotNull())), F.lit(0.0))


def yes_certainty(p: Column) -> Column:
    return F.abs(p - 0.5) * 2


def choice_certainty(p: Column) -> Column:
    return F.array_max(p)


def rounded_level(position: Column, levels: Column) -> Column:
    """The level nearest a position, half up."""
    return F.least(F.floor(position * (levels - 1) + 0.5), levels - 1).cast("int")


def valid_distribution(labels: Column, p: Column) -> Column:
    """As many labels as probabilities, no label twice, and a sum of 1 within 1e-3."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return (F.size(labels) == F.size(p)) & (F.size(F.array_distinct(labels)) == F.size(labels)) & (F.abs(total - 1) <= 1e-3)
