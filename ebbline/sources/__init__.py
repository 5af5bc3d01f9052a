"""Batch sources and sinks: files, paged REST endpoints, generated events."""

from ebbline.sources.files import read_table, write_features, write_optimized, write_staging
from ebbline.sources.generate import generate_events
from ebbline.sources.rest import ApiExtractor, RateLimiter, RestPages, fetch_with_retry, validate_records

__all__ = ["ApiExtractor", "RateLimiter", "RestPages", "fetch_with_retry", "generate_events", "read_table", "validate_records", "write_features", "write_optimized", "write_staging"]
