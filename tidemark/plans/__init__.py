"""plans of the cache-analytics library."""
