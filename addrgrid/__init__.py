"""addrgrid: address verification, geocoding and hierarchy browsing on Spark.

Every public function takes and returns DataFrames (or Columns); the work is
planned by Catalyst and runs distributed. See README.md for the map of
operators.
"""

__version__ = "0.1.0"
