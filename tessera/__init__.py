"""Spark-native engine that generates, profiles, perturbs, judges and exports datasets."""

__version__ = "0.1.0"
