"""Ledgerlight: a Spark-native analytics engine for assistant session logs."""
