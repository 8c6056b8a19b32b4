"""bibliomill: jobs over a scholarly text collection kept as Spark tables.

Every public function takes DataFrames (plus small parameters) and returns a lazy
DataFrame; nothing here collects a result.  The only reads on the driver are
size-checked dimensions, see ``bibliomill.functions.dims.small_rows``.
"""

__version__ = "0.1.0"
