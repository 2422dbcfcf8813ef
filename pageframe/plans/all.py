"""Imports every plan module so that each registers itself."""

from pageframe.plans import edits, forms, geometry, redact, reports, runs, sources, text  # noqa: F401
