"""citeforge: citation-grounded retrieval and answer verification as Spark plans."""
