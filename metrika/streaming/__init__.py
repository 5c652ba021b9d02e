"""streaming of the phonetic text engine."""
