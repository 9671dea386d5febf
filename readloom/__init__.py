"""readloom: sequencing reads as Spark DataFrames, and a small typed script language that compiles to Spark plans."""
