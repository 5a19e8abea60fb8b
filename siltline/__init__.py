"""Storage-forensics analytics and corpus preparation on Apache Spark."""
