"""siftlake: document retrieval and analytics as PySpark DataFrame plans."""
