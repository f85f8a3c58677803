"""The pipeline on streams."""
