"""gristmill: grinding messy source data into tables, graphs and searchable text on Spark."""
