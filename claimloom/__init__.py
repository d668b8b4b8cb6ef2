"""claimloom: claims, evidence and snapshot analytics on Spark DataFrames."""
