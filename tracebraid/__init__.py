"""Spark-native relation recovery, incident analytics and corpus preparation."""
