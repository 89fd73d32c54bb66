"""Spark-native logistic regression analytics and training-data operators."""
