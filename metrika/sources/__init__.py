"""sources of the phonetic text engine."""
