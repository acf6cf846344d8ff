"""operators of the cache-analytics library."""
