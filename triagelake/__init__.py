"""Spark-native triage of customer messages and the evaluation around it."""
