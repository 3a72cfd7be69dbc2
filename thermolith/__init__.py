"""Thermolith: facility-energy time series on Spark."""
