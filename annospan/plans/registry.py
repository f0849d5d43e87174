"""Import every query module so that the registry is complete."""

from annospan.plans import (  # noqa: F401
    compare_queries,
    enrichment_queries,
    interval_queries,
    scalar_queries,
    similarity_queries,
    source_queries,
    summary_queries,
    transfer_queries,
    triple_queries,
    vocab_queries,
)
from annospan.plans.base import QUERIES, SQL  # noqa: F401
