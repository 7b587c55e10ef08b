"""Pair-based heritability estimation, and operations around it, as Spark jobs."""
