"""plans of the phonetic text engine."""
