"""Wardflow: content-risk analytics over untrusted text, as Spark DataFrame operators."""

__version__ = "0.1.0"
