"""functions of the cache-analytics library."""
