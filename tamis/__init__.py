"""Spark-native ticket triage, log forensics and corpus preparation."""
