"""veinlode: analytics over software-repository history, as PySpark DataFrame programs."""
