"""factloom: a Spark-native engine for analysis facts (findings, graphs, taint labels, scans)."""
