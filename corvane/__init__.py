"""corvane: relational and corpus operators written as Spark DataFrame jobs."""
