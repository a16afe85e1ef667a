"""Spark-native engine for labelling, ordering and explaining groups of observations."""
