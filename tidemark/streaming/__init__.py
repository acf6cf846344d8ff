"""streaming of the cache-analytics library."""
