"""airgrid: Spark-native analysis of gridded and point air-quality observations.

Every operator takes a DataFrame and returns a DataFrame.  See README.md for the data model.
"""

KEYS = ("dataset_id", "variable")
CELL = ("y", "x")
