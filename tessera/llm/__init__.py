"""Operators for building language-model training data, each a Spark job over a table of documents or pages."""
