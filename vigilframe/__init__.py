"""Spark-native classification analytics: submissions, caches, frame scans, gates, state log."""
