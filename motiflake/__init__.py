"""motiflake: graphlet analytics and corpus preparation on PySpark DataFrames."""
