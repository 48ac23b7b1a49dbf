"""Named queries over the tables."""

from . import alignment_queries, attribution_queries, audit_queries, bundle_queries, check_queries, constraint_queries, evidence_queries, family_queries, identity_queries, library_queries, metric_queries, refined_queries, search_queries, series_queries, service_queries, shape_queries, store_queries, table_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
