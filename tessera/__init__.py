"""Tessera: a Spark-native engine for typed, graph-linked text records."""
