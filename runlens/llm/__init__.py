"""Operators for training-data pipelines. Nothing outside this subpackage imports it, except the driver's entry file."""
