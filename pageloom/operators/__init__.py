"""DataFrame operators; each takes and returns DataFrames and stays lazy
unless its docstring says that it writes intermediate tables."""
