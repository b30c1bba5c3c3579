"""Stages, their parser, lineage, compilation and affect analysis."""
