"""Spark-native analytics for agent memory: conversations, knowledge, context and entities."""
