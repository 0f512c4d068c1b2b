"""Physical layout, and the registered queries with their SQL."""
