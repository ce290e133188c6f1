"""vigilspark: message-risk analytics as PySpark DataFrame pipelines."""
