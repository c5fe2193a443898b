"""A relational engine in Spark: a SQL dialect's operators, functions, sources and change streams over DataFrames."""
