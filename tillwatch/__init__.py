"""tillwatch: account-risk analytics expressed as Spark DataFrame jobs."""
