"""Metrika: phonetic text analytics and corpus preparation on Spark DataFrames."""
