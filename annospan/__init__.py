"""annospan: DataFrame operators for tables of annotated intervals."""
