"""Spark-native analytics over network flow records: cleaning, reference
statistics, scoring, triage, evaluation and monitoring as DataFrame jobs."""
