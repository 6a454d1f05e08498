"""A PySpark engine for hybrid retrieval and bulk curation over collections of notes."""
