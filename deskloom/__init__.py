"""Service-desk ticket analytics as PySpark DataFrame operators."""
