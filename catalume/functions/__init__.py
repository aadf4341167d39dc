"""Functions of the catalog library."""
