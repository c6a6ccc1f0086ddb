"""Column-level helpers: scoring, text matching, formatting, fixed vocabularies."""
