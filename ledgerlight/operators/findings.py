"""The common form of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("agent", "rule_id", "severity", "entity_type", "entity_id", "summary", "standalone", "scored", "details")


def finding(df: DataFrame, agent: str, rule_id: str, severity, entity_type: str, entity_id, summary, facts=(), standalone=True, scored=True) -> DataFrame:
    """facts: columns that stay typed, and go into details as text too. A finding that can't stand alone is context and adds nothing to a score."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    pairs = [x for f in facts for x in (F.lit(f), F.col(f).cast("string"))]
    details = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    eid = F.col(entity_id) if isinstance(entity_id, str) else entity_id
    return df.select(F.lit(agent).alias("agent"), F.lit(rule_id).alias("rule_id"), lit(severity).alias("severity"), F.lit(entity_type).alias("entity_type"), eid.cast("string").alias("entity_id"), lit(summary).alias("summary"), lit(standalone).alias("standalone"), (lit(scored) & lit(standalone)).alias("scored"), details.alias("details"), *facts)


def together(*frames: DataFrame) -> DataFrame:
    """All findings of all rules in the common form."""
    out = frames[0].select(*COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*COLUMNS))
    return out
