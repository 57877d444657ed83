"""Spark-native context distillation, agent memory and corpus preparation."""
