"""corpusmill: a Spark-native engine for document-corpus analytics and retrieval."""

__version__ = "0.1.0"
