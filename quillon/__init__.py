"""Cohort analytics as DataFrame operators."""
