"""markloom: chart specifications as queries over Spark DataFrames, with a script-corpus toolkit and evaluation reports."""
