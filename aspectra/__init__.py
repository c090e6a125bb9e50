"""aspectra: review-text analytics as Spark DataFrame operators.

Every operator takes DataFrames (and small, size-checked word-list tables)
and returns a DataFrame; nothing is collected to the driver except word
lists whose size is bounded and checked (see ``aspectra.lexicons``).
"""

from aspectra.session import checkpoint_dir, get_spark

__all__ = ["checkpoint_dir", "get_spark"]
