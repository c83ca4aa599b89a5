"""Manufacturing defect analytics as Spark DataFrame operators."""
