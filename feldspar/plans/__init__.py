"""Compilation of expressions and reusable pipelines."""
