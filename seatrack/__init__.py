"""Maritime track analytics and training-data operators on Apache Spark."""
