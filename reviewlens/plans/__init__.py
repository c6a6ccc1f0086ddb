"""Session settings and the registered queries with their SQL equivalents."""
