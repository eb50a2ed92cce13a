"""Point-in-time panel analytics and training-data operators as Spark DataFrame jobs."""
