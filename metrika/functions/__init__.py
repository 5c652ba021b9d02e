"""functions of the phonetic text engine."""
