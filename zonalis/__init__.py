"""Mobility-zone analytics as DataFrame functions on PySpark."""
