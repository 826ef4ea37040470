"""All queries of the library with their oracle SQL, collected from ``plans``."""

from __future__ import annotations

from quartzfolio.plans import analytics, fields, ingest, ingestion, learning, metrics, portfolio, prioritize, quality, relations, sectors, similarity, validation, variants
from quartzfolio.plans.common import Query

FLAGSHIP = "prioritize_parts"
PLANS = (prioritize, metrics, similarity, quality, analytics, ingest, portfolio, validation, fields, variants, learning, sectors, ingestion, relations)


def queries() -> dict[str, Query]:
    return {k: v for p in PLANS for k, v in p.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in PLANS for k, v in p.R.sql.items()}
