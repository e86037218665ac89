"""Postmark: a Spark-native engine that checks, corrects and resolves postal addresses."""
