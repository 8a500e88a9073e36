"""Operations of a training-data pipeline over documents, labels and embeddings.

Every operator takes and returns DataFrames, keeps Spark in charge of partitioning and
shuffles, and states in its docstring what it does with nulls, empty and long texts,
ties, repeated rows, empty tables and clashing column names.
"""
