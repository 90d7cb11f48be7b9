"""Evidence-grounded failure analysis and corpus preparation on PySpark."""
