"""Jet and ACE database files (.mdb, .accdb): pages, table definitions, rows, and a Spark data source."""
