"""Whole plans: verification runs and guarded SQL."""
