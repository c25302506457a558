"""Operators for pipelines of training data. Nothing outside this subpackage imports it."""
