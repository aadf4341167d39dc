"""Plans of the catalog library."""
