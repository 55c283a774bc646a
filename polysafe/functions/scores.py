"""Scalar score expressions (Column -> Column), all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def harmonic(refusal: Column, over_refusal: Column) -> Column:
    """Harmonic mean of refusal and (100 - over-refusal) on 0..100 scales; 0/0 -> null."""
    comp = F.lit(100.0) - over_refusal
    return F.try_divide(F.lit(2.0) * refusal * comp, refusal + comp)


def complement(over_refusal: Column) -> Column:
    return F.lit(100.0) - over_refusal


def composition_languages(model: Column) -> Column:
    return F.split(model, "_")


def composition_arity(model: Column) -> Column:
    return F.size(F.split(model, "_"))


def marker_weight(model: Column) -> Column:
    """Scatter marker size ``60 * n^2`` for a composition of n languages."""
    n = composition_arity(model)
    return F.lit(60) * n * n


def in_distribution(language: Column, model: Column) -> Column:
    """Eval language is English or one of the composition's languages."""
    return F.array_contains(F.array_union(F.array(F.lit("en")), F.split(model, "_")), language)


def resource_class(cat: Column) -> Column:
    """Five-level resource taxonomy (0..5) -> low / middle / high."""
    c = cat.cast("int")
    return (F.when(c.between(0, 2), F.lit("low")).when(c.between(3, 4), F.lit("middle"))
            .when(c == 5, F.lit("high")))


def display_round(x: Column) -> Column:
    return F.round(x, 1)
