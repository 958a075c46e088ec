"""PySpark library that turns published documents into traceable events.

Every public operator takes DataFrames (plus plain configuration values) and
returns DataFrames.  Nothing is collected to the driver unless a docstring says so.
"""
