"""Training-data operators: each works on a DataFrame and returns a DataFrame.

Nothing outside this subpackage imports it.  Operators take the names of their columns as
parameters, read no other column, and so ignore extra columns whatever they are called.
"""
