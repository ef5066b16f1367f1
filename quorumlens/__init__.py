"""Spark-native analytics for comparing labels from panels of services and models."""
