"""Spark jobs for labelled sequence tables: parsing, similarity, folds, scoring, resampling and audits."""
