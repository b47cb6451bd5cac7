"""tagflow: declarative tag / item / step dataflow expressed as Spark DataFrames."""
