"""Imports the modules that register queries."""

from quillspark.plans import advanced, audits, filesets, imports, lines, markup, more, relational, scalar, web  # noqa: F401
