"""Document-layout data work on Spark: runs, paragraphs, positions, redaction, forms and edits."""

__version__ = "0.1.0"
