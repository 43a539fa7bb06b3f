"""sumweave: multi-way equi-join sums over unsigned 64-bit columns, on Spark."""
