"""Ledgerloom: Spark-native processing of filings, facts, documents and conversations."""

__version__ = "0.1.0"
