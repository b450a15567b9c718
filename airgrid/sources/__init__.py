"""Reading and writing of cubes, series, point tables and file listings."""
