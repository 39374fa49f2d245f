"""docquarry: a Spark-first engine for document corpora.

Chunking, retrieval, catalogue, intake and queue operators are DataFrame plans;
Python runs only inside tasks, on Arrow batches, where an algorithm walks text.
"""
