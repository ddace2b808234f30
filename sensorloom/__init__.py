"""sensorloom: DataFrame operators for sensor-cohort analytics on Spark."""
