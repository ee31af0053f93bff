"""engramlake: agent-memory evaluation analytics as PySpark DataFrame jobs."""
