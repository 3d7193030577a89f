"""Lectern: document analytics on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame. Catalyst plans the
relational part; Arrow-batched Python runs only where built-in expressions cannot
state the semantics (Markdown scanning, per-document folds).
"""

__version__ = "0.1.0"
