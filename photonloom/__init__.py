"""Survey-science analytics on Spark: cohorts, pixel tables, prediction tables and ensembles."""
