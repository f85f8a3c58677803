"""Sightline: a PySpark-native engine for object-sighting data.

Annotated-image manifests, per-frame detections and text reads come in as
DataFrames; grouped splits, duplicate audits, tracks, votes, grammar-checked
plates, cooldown logs and evaluation reports go out as DataFrames.
"""
