"""Forecast verification and feature tables on Spark."""
