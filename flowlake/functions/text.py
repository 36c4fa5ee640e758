"""Number and alert text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlake.functions import fixed


def fixed_decimals(c: Column, places: int) -> Column:
    """Plain ``0.1234`` text. ``format_number`` rounds the exact binary value half-even."""
    return F.regexp_replace(F.format_number(c.cast("double"), places), ",", "")


def percent_text(c: Column) -> Column:
    """0.9234 -> ``92.3%``."""
    return F.concat(fixed_decimals(c * 100, 1), F.lit("%"))


def number_text(c: Column) -> Column:
    """Grouped whole number above 1000 in magnitude, else four decimals."""
    # The one double at which format_number takes a value above the tie for the tie itself.
    quirk = F.when(c < 0, "-0.0001").otherwise("0.0001")
    return (F.when(F.abs(c) > 1000, F.format_number(c.cast("double"), 0))
            .when(F.abs(c) == 5e-05, quirk)
            .otherwise(fixed_decimals(c, 4)))


def feature_text(available: Sequence[str],
                 features: Sequence[str] = fixed.KEY_FEATURES) -> Column:
    """One line per key feature that is present, not missing and not zero."""
    lines = [
        F.when(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.col(f) != 0),
               F.concat(F.lit(f"  - {f}: "), number_text(F.col(f))))
        for f in features if f in available]
    if not lines:
        return F.lit(fixed.NO_FEATURES_TEXT)
    kept = F.array_compact(F.array(*lines))
    return (F.when(F.size(kept) == 0, F.lit(fixed.NO_FEATURES_TEXT))
            .otherwise(F.array_join(kept, "\n")))


def definitions_text() -> str:
    return "\n".join(f"- {label}: {meaning}" for _, label, meaning in fixed.FEATURE_DEFINITIONS)


def prompt_text(scenario: Column, description: Column, number: Column, confidence: Column,
                features: Column) -> Column:
    """The question sent to an analyst or a text model."""
    return F.concat(
        F.lit(fixed.PROMPT_OPENING), description,
        F.lit(fixed.PROMPT_AFTER_SCENARIO), number.cast("string"),
        F.lit(fixed.PROMPT_AFTER_NUMBER), percent_text(confidence),
        F.lit(fixed.PROMPT_AFTER_CONFIDENCE), features,
        F.lit(fixed.PROMPT_BEFORE_DEFINITIONS + definitions_text() + fixed.PROMPT_QUESTIONS),
        scenario, F.lit(fixed.PROMPT_CLOSING))


def preview(c: Column, chars: int = fixed.PREVIEW_CHARS) -> Column:
    """The first characters on one line."""
    return F.translate(F.substring(c, 1, chars), "\n", " ")
