"""quillon: a Spark-native engine for project memories.

A memory is a property graph, a document store, chunk vectors and a text
index, all held as Spark DataFrames and queried with DataFrame operators.
"""
