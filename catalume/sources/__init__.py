"""Sources of the catalog library."""
