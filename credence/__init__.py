"""Credence: a trust-lattice dataflow engine on Spark DataFrames."""
