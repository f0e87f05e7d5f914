"""A personal-data firewall for tables and streams, written as Spark DataFrame jobs."""
