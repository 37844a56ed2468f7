"""leadloom: lead-processing analytics on PySpark."""
