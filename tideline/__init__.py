"""Labelled time-series and operations-report analytics on Spark."""

from tideline.model import Grid, build_session, vector

__all__ = ["Grid", "build_session", "vector"]
