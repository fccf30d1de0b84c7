"""From syntax trees to one Spark SQL statement, and checks before it runs."""
