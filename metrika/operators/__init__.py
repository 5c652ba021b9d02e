"""operators of the phonetic text engine."""
