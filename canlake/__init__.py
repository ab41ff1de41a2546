"""canlake: CAN-bus intrusion analytics as Spark DataFrame operators."""
