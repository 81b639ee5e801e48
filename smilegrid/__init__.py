"""Spark-first analytics for option surfaces, panels, labels and risk."""
