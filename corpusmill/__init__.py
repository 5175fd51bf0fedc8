"""Spark-native engine for text corpora: cleaning, retrieval, graphs and evaluation."""
