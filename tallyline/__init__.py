"""Monthly sales analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; nothing is collected to
the driver unless a docstring says so, and no operator keeps global state.
"""

__version__ = "0.1.0"
