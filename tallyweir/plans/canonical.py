"""One canonical observation table from yearly sheets whose coding differs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.functions import dates
from tallyweir.functions.missing import in_set, keep_in
from tallyweir.functions.numbers import condition_factor


@dataclass(frozen=True)
class SeasonRule:
    """How one season codes its observations.

    ``species`` and ``size_classes`` select rows (None = all; a None entry keeps missing values).
    ``split_clipped`` separates clipped animals into hatchery fish and recaptured wild fish by
    their second mark. From ``transfer_from`` on, animals given a batch mark count as released at
    ``transfer_site``, wherever they were caught.
    """

    species: tuple | None = None
    size_classes: tuple | None = None
    split_clipped: bool = False
    transfer_from: str | None = None
    transfer_site: str = "barn"


# Size classes, codes and dates as the two seasons use them.
SEASON_2024 = SeasonRule(species=("co-w",), size_classes=(None, "small", "big", "bigger", "biggest"))
SEASON_2025 = SeasonRule(
    size_classes=(None, "Unknown", "S", "M", "L"), split_clipped=True, transfer_from="2025-06-19"
)
BATCH_MARKS = ("top", "bottom")
WILD_CODES = ("co-w", "co-w.r")


def fate() -> Column:
    """Sacrificed, dead or live; a sacrifice outranks a death."""
    return F.when(F.col("sacrifice").isNotNull(), "sacrifice").when(F.col("mort").isNotNull(), "mort").otherwise("live")


def tag_status() -> Column:
    """A: marked here and released alive. R: came with a mark. NULL: neither."""
    applied = F.col("a_adclip").isNotNull() & (F.col("fate") == "live")
    return F.when(applied, "A").when(F.col("r_adclip").isNotNull(), "R")


def clipped_species() -> Column:
    clipped = in_set("species", ["co-a"])
    return (
        F.when(clipped & in_set("r_caudalclip", ["none"]), "co-h")
        .when(clipped & in_set("r_caudalclip", BATCH_MARKS), "co-w.r")
        .otherwise(F.col("species"))
    )


def release_site(rule: SeasonRule) -> Column:
    if rule.transfer_from is None:
        return F.col("site")
    late = F.col("date") >= F.lit(rule.transfer_from).cast("date")
    moved = late & in_set("a_caudalclip", BATCH_MARKS)
    return F.when(moved, rule.transfer_site).when(~moved, F.col("site"))


def wild(fish: DataFrame) -> DataFrame:
    """Wild animals, those recaptured with a clip among them."""
    return keep_in(fish, "species", WILD_CODES)


def canonical_fish(raw: DataFrame, rule: SeasonRule) -> DataFrame:
    """Rows of a season with fate, tag status, release site, calendar keys and condition factor."""
    out = raw
    if rule.species is not None:
        out = keep_in(out, "species", rule.species)
    if rule.size_classes is not None:
        out = keep_in(out, "size_cwt", rule.size_classes)
    out = out.withColumn("fate", fate()).withColumn("tag_status", tag_status())
    if rule.split_clipped:
        out = out.withColumn("species", clipped_species())
    return out.withColumns(
        {
            "release_site": release_site(rule),
            "iso_year": dates.iso_year("date"),
            "iso_week": dates.iso_week("date"),
            "year_day": dates.day_of_year("date"),
            "week": dates.week_start("date"),
            "k": condition_factor("weight_g", "fork_length_mm"),
        }
    )
