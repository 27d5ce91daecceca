"""Conversation analytics and corpus preparation on Apache Spark."""
