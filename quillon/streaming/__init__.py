"""Visits are discrete and panels are tables: no operator of this engine needs a stream."""
