"""Records, epoch tables and the catalog of indexes."""
