"""Spark-native scanning of source corpora for technical compliance signals."""

__version__ = "0.2.0"
