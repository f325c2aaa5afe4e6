"""domframe: Spark-first analytics and extraction over collections of web pages."""
