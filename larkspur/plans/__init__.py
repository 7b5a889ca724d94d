"""From syntax trees to Spark SQL."""
