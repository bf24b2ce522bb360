"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; a policy is a version name and the mask of the rules it enforces, so that trying another policy
or leaving a rule out needs no text again. Ablations come from one aggregation by bit pattern.

Defined results: a null or blank text has no words and fails ``few_words``; repeated rows are judged
one by one; an empty table gives an empty ledger; columns of the input other than the text are kept
(``ledger``), and input columns named like a ledger column are replaced by the ledger's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.text import covered, let, repeated_windows, whole, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"  # fixed value of the contract
BLANK_CHARACTERS = " \t\n\x0b\x0c\r"
#: Runs of ASCII or Latin characters; scripts that set no blanks between words have none.
LATIN_RUN = r"[\x21-\x7E\u00A1-\u024F\u1E00-\u1EFF]+"
#: A table row, its single bars, and a bar that stands alone.
TABLE_LINE, TABLE_BAR, LONE_BAR = r"^\s*\|.*[^|\s].*\|\s*$", r"(?<!\|)\|(?!\|)", r"(?<!\S)\|(?!\S)"


@dataclass(frozen=True)
class Rule:
    """One test of the measurements; ``failed`` is a SQL condition on the ledger's columns."""

    name: str
    failed: str


#: Position in the list is the bit; new rules go to the end. The first two are the base rules.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "2 * n_symbols > n_words"),
    Rule("exclamation", "2 * n_exclaimed > n_words"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines AND n_lines >= 4"),
    Rule("symbols_off_tables", "2 * (n_symbols - n_bars) > n_words - n_bar_words"),
    Rule("long_latin_words", "latin_chars > 40 * n_latin_runs AND 2 * latin_chars > word_chars"),
)
BASE = ("few_words", "repeated_words")


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    at = {rule.name: bit for bit, rule in enumerate(rules)}
    return sum(1 << at[name] for name in names)


#: Versioned policies: version -> mask. A published version is never changed.
POLICIES = {
    "base": mask_of(BASE),
    "v1": mask_of(("few_words", "repeated_words", "symbols", "exclamation", "long_words")),
    "v2": mask_of(("few_words", "repeated_words", "symbols", "exclamation", "long_words", "repeated_lines")),
    "v3": mask_of(("few_words", "repeated_words", "exclamation", "symbols_off_tables", "long_latin_words")),
}
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaimed", "n_bars", "n_bar_words", "n_latin_runs", "latin_chars",
)


def measurements(text: Column) -> Column:
    """A struct of all measurements of one text."""
    body = whole(text)
    lines = F.filter(F.split(body, "\n", -1), lambda line: F.btrim(line, F.lit(BLANK_CHARACTERS)) != "")

    def chars(column: Column) -> Column:
        return F.char_length(column).cast("long")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: x == "|")).cast("long").alias("n_bar_words"),
            covered(repeated_windows(w, WINDOW), WINDOW).alias("n_repeat_words"),
            let(
                F.array_join(w, ""),
                lambda kept: F.struct(
                    chars(kept).alias("chars"),
                    (chars(kept) - chars(F.translate(kept, SYMBOLS, ""))).alias("symbols"),
                    F.floor((chars(kept) - chars(F.replace(kept, F.lit("!!"), F.lit("")))) / 2).alias("exclaimed"),
                ),
            ).alias("k"),
        )

    def bars(line: Column) -> Column:
        return F.when(line.rlike(TABLE_LINE), F.regexp_count(line, F.lit(TABLE_BAR))).otherwise(F.regexp_count(line, F.lit(LONE_BAR)))

    def of_lines(found: Column) -> Column:
        barred = F.filter(found, lambda line: F.contains(line, F.lit("|")))
        return F.struct(
            F.aggregate(F.transform(barred, bars), F.lit(0).cast("long"), lambda n, k: n + k).alias("n_bars"),
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        )

    return let(
        F.struct(
            let(words(body), of_words).alias("w"), let(lines, of_lines).alias("l"), F.regexp_count(body, F.lit(LATIN_RUN)).cast("long").alias("runs"),
            (chars(body) - chars(F.regexp_replace(body, LATIN_RUN, ""))).alias("latin"),
        ),
        lambda x: F.struct(
            x["w"]["n_words"].alias("n_words"),
            x["w"]["k"]["chars"].alias("word_chars"),
            x["w"]["k"]["symbols"].alias("n_symbols"),
            x["l"]["n_lines"].alias("n_lines"),
            x["l"]["n_dup_lines"].alias("n_dup_lines"),
            x["w"]["n_repeat_words"].alias("n_repeat_words"),
            x["w"]["k"]["exclaimed"].alias("n_exclaimed"),
            x["l"]["n_bars"].alias("n_bars"),
            x["w"]["n_bar_words"].alias("n_bar_words"),
            x["runs"].alias("n_latin_runs"),
            x["latin"].alias("latin_chars"),
        ),
    )


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measurements and ``failed_bits``, the bits of the rules that the text fails."""
    plain = docs.drop("_m", *[c for c in (*MEASURES, "failed_bits") if c != text])
    measured = plain.withColumn("_m", measurements(F.col(f"`{text}`")))
    spread = measured.withColumns({name: F.col("_m")[name] for name in MEASURES}).drop("_m")
    bits = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(F.expr(rule.failed), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, rule in enumerate(rules)],
    )
    return spread.withColumn("failed_bits", bits.cast("long"))


def passes(policy: str, bits: str = "failed_bits") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(rows: DataFrame, policies: dict[str, int] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule in it: documents that fail the rule, and that only this rule keeps out.

    The ledger is first reduced to a count per bit pattern, so the rest works on at most 2**rules rows.
    """
    patterns = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    masks = {"base": POLICIES["base"]} if policies is None and rules != RULES else (policies or POLICIES)
    cases = F.explode(
        F.array(
            *[
                F.struct(F.lit(v).alias("policy"), F.lit(r.name).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(1 << b).cast("long").alias("bit"))
                for v, m in masks.items()
                for b, r in enumerate(rules)
                if m >> b & 1
            ]
        )
    )
    each = patterns.select("failed_bits", "n", cases.alias("c")).select("failed_bits", "n", "c.*")
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("mask")) == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
    )
