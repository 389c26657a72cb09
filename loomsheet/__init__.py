"""loomsheet: a PySpark-native workbench engine for tables.

Every operator takes DataFrames and returns DataFrames; Catalyst plans the work.
"""
