"""Scans: label files, export trees, manifests, journals, frame sources."""
