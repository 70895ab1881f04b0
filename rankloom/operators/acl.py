"""Who may see what: tenant, source and groups, as one expression that filters below every ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TENANT = "tenant_redwood"


def group_labels(scope: Column) -> Column:
    return F.transform(scope, lambda s: F.concat(F.lit("source:"), s))


def visible(scope: Column, tenant_id: Column, source_type: Column, allowed: Column, denied: Column, tenant: str = TENANT) -> Column:
    """Whether a question of this scope (source types) sees a record. An empty or null scope sees everything, tenant and groups unchecked. Else tenant and source must
    fit, an allowed group must be one of the scope's, and no denied group may be. Null groups are empty."""
    none = F.array().cast("array<string>")
    wanted = F.filter(F.coalesce(scope, none), lambda s: s.isNotNull())
    labels = group_labels(wanted)
    fits = (tenant_id == tenant) & F.array_contains(wanted, source_type) & F.arrays_overlap(F.coalesce(allowed, none), labels)
    return F.when(F.size(wanted) == 0, F.lit(True)).otherwise(F.coalesce(fits & ~F.coalesce(F.arrays_overlap(F.coalesce(denied, none), labels), F.lit(False)), F.lit(False)))
