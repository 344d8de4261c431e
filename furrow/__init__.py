"""Furrow: release repair, settings, forecasting and recommendation tables on PySpark."""
