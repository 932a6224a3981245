"""Spark engine for checking and reconciling tables held as exact text."""
