"""Spark-native research engine for intraday bar shapes."""
