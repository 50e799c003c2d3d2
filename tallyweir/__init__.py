"""tallyweir: packet-trace flow analytics and corpus preparation on Spark DataFrames."""
