"""Spatial ligand-receptor interaction motifs as Spark DataFrame jobs."""
