"""Queries on the text tables that are no numbered operator; none where ``tallyweir.llm`` is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from catalog.registry import query
from catalog.tables import Tables

try:
    from tallyweir.llm import queries as llm
except ModuleNotFoundError as missing:  # the subpackage can be left out as a whole; any other missing module is an error
    if missing.name not in ("tallyweir.llm", "tallyweir.llm.queries"):
        raise
else:

    @query("", llm.ABLATIONS_SQL)
    def quality_ablations(t: Tables) -> DataFrame:
        """For every policy and rule: documents that fail the rule, and that nothing but the rule keeps out."""
        return llm.quality_ablations(t.spark, t.folder)
