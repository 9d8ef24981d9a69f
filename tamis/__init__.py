"""Tamis: retrieval, conversation statistics, document and table analytics as Spark DataFrame plans."""
