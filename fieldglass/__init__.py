"""Mobility and place analytics on PySpark."""
