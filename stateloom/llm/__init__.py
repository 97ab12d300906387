"""Training-data operators at corpus scale.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
column names and returns a DataFrame; ``queries`` binds them to the test tables.
"""
