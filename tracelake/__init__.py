"""Provenance-first analytics over append-only conversation and tool logs, on Spark."""

__version__ = "0.1.0"
