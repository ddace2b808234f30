"""Part of sensorloom."""
