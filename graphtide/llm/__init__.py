"""Operators for training-data pipelines. Nothing else in graphtide imports this subpackage."""
