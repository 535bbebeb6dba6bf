"""Batch table jobs on Spark for fee reports, a product catalogue and a timetable."""
