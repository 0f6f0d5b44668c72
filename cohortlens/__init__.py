"""cohortlens: cohort and domain-generalization analytics as Spark jobs."""

__version__ = "0.1.0"
