"""Emberscan: finding emerging narratives in streams of short posts, on Spark.

Every operator is a function from DataFrames to a DataFrame. Operators that
depend on the clock take ``now`` as a naive UTC ``datetime``; nothing reads the
wall clock.
"""
