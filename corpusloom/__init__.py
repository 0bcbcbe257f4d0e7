"""corpusloom: a Spark-native engine for curating, planning, packing and auditing training data."""
