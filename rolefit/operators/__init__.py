"""DataFrame operators: staging, dedup, curation, enrichment, matching."""
