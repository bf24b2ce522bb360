"""Coded tags: retention, releases, size at tagging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.dates import iso_week
from tallyweir.functions.missing import sum_strict, sum_where
from tallyweir.operators import accounting
from tallyweir.operators.biology import size_summary
from tallyweir.operators.joins import left_join
from tallyweir.operators.ordering import sort_missing_last
from tallyweir.sources.readers import literal_table
from tallyweir.sources.writers import present

# Rates that replace the measured ones where the code changed within a week or no
# check was made, and the length range of each head mould (none fitted = the smallest fish).
RATE_OVERRIDES = (
    ("18-60-75", 21, 0.9835979),
    ("18-47-83", 23, 1.0),
    (None, 19, 1.0),
    (None, 26, 1.0),
)
MOLD_KEY = ((None, "<70"), ("10", "70-85"), ("15", "86-115"), ("20", "116-190"))
TAG_TABLE_HEADINGS = {
    "tag_code": "Tag Code",
    "injected": "#Inj",
    "est_lost": "Est.Lost",
    "n_retagged": "#Re-tagged",
    "net_releases": "Total Releases",
    "mean_length": "Mean FL(mm)",
    "sd_length": "SD FL(mm)",
    "mean_weight": "Mean Wt(g)",
    "sd_weight": "SD Wt(g)",
}


def prepared_log(log: DataFrame) -> DataFrame:
    """Week of tagging; missing deaths and sacrifices are zero."""
    return log.withColumns(
        {
            "iso_week": iso_week("tag_date"),
            "mort_n": F.coalesce("mort_n", F.lit(0.0)),
            "sacrifice_n": F.coalesce("sacrifice_n", F.lit(0.0)),
        }
    )


def weekly_retention(log: DataFrame) -> DataFrame:
    return accounting.retention_rates(prepared_log(log), ["iso_week"])


def detailed_retention(log: DataFrame) -> DataFrame:
    """By week, head mould and code, from the batches that were checked."""
    checked = prepared_log(log).where(F.col("r_check_date").isNotNull())
    return accounting.retention_rates(
        checked, ["iso_week", "head_mold_size", "tag_code"], retagged="r_re_tagged_n"
    )


def retention_by_code(log: DataFrame) -> DataFrame:
    return accounting.retention_rates(prepared_log(log), ["tag_code"], counts=True)


def _batches(log: DataFrame) -> DataFrame:
    """Net injections per week and code meet the week's rate: the log is reduced before the join."""
    net = F.col("inj_n") - F.col("mort_n") - F.col("sacrifice_n")
    batches = (
        prepared_log(log).groupBy("iso_week", "tag_code", "head_mold_size").agg(sum_strict(net).alias("inj"))
    )
    return left_join(batches, weekly_retention(log), ["iso_week"])


def tag_summary(log: DataFrame) -> DataFrame:
    return accounting.release_summary(_batches(log), ["tag_code"], F.col("inj"))


def tag_summary_by_mold(log: DataFrame, length_key: Sequence[tuple[str | None, str]]) -> DataFrame:
    """Per code and head mould, with percent retention and the mould's length range.

    The key is explicit; a NULL mould is a key of its own.
    """
    table = literal_table(log.sparkSession, length_key, "head_mold_size STRING, length_range_mm STRING")
    out = accounting.release_summary(_batches(log), ["tag_code", "head_mold_size"], F.col("inj"))
    return left_join(accounting.retention_percent(out), table, ["head_mold_size"])


def injections(fish: DataFrame, keys: Sequence[str], live_only: bool = True) -> DataFrame:
    """Tagged animals from the individual records: injected alive, dead, sacrificed."""
    rows = fish.where(F.col("tag_code").isNotNull())
    if live_only:
        rows = rows.where(F.col("fate") == "live")
    return rows.groupBy(*keys).agg(
        sum_where(F.col("fate") == "live", "count").alias("inj_n"),
        sum_where(F.col("fate") == "mort", "count").alias("mort_n"),
        sum_where(F.col("fate") == "sacrifice", "count").alias("sacrifice_n"),
    )


def injections_with_rates(fish: DataFrame, log: DataFrame, overrides=RATE_OVERRIDES) -> DataFrame:
    """Daily injections with the retention of their week, code and mould, exceptions applied."""
    table = literal_table(fish.sparkSession, overrides, "tag_code STRING, iso_week INT, rate DOUBLE")
    daily = injections(fish, ["iso_week", "date", "site", "tag_code", "head_mold_size"]).drop("mort_n", "sacrifice_n")
    rated = left_join(daily, detailed_retention(log), ["iso_week", "tag_code", "head_mold_size"])
    return accounting.apply_overrides(rated, table)


def retags(log: DataFrame) -> DataFrame:
    return accounting.retag_totals(log)


def retags_from_checks(log: DataFrame) -> DataFrame:
    return detailed_retention(log).groupBy("tag_code").agg(sum_strict("n_retagged").alias("n_retagged"))


def net_releases(fish: DataFrame, log: DataFrame) -> DataFrame:
    """Net tagged releases per code: weekly rates, no retag counted as zero."""
    weekly = injections(fish, ["iso_week", "tag_code"])
    rated = left_join(weekly, weekly_retention(log), ["iso_week"])
    out = accounting.release_summary(rated, ["tag_code"], F.col("inj_n"))
    return accounting.net_releases(out, retags(log))


def net_releases_detailed(fish: DataFrame, log: DataFrame, overrides=RATE_OVERRIDES) -> DataFrame:
    """Net tagged releases per code: detailed rates, a missing retag stays unknown."""
    rated = injections_with_rates(fish, log, overrides)
    out = accounting.release_summary(rated, ["tag_code"], F.col("inj_n"))
    return accounting.net_releases(out, retags_from_checks(log), retag_null_as_zero=False)


def size_by_code(fish: DataFrame, digits: int | None = 1) -> DataFrame:
    return size_summary(fish, ["tag_code"], digits)


def final_tag_table(fish: DataFrame, log: DataFrame) -> DataFrame:
    """Releases with size at tagging, ordered by mean length."""
    out = left_join(net_releases(fish, log), size_by_code(fish).drop("n_rows", "n_measured"), ["tag_code"])
    return sort_missing_last(out, "mean_length")


def presented_tag_table(fish: DataFrame, log: DataFrame) -> DataFrame:
    return present(final_tag_table(fish, log), TAG_TABLE_HEADINGS)
