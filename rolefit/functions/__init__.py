"""Column functions: text, vocabularies, normalisation, extraction, scoring."""
