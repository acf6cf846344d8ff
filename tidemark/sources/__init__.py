"""sources of the cache-analytics library."""
