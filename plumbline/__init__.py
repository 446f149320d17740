"""Plumbline: Spark DataFrame operators for profiling, cleaning, exploring,
modelling and reporting on tables of any size."""
