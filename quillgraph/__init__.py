"""quillgraph: a Spark-native engine for linking documents and preparing text corpora."""

__version__ = "0.1.0"
