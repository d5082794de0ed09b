"""veriloom: a PySpark-native engine for verifiable question-answer data."""

__version__ = "0.1.0"
