"""Normalising, ranking, folds and classifiers on Spark ML."""
