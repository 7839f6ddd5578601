"""Column functions: text forms, field parsers, closed vocabularies."""
