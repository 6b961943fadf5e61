"""Spark-native analytics for event-contract and interest-rate market data."""
