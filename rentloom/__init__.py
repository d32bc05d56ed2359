"""rentloom: rental-market analytics and corpus preparation as Spark jobs."""
