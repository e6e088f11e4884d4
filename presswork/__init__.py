"""Presswork: agent-text compression analytics as Spark DataFrame operators."""
