"""Spark-native workbench for labelled temporal property graphs."""

__version__ = "0.1.0"
