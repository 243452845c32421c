"""tagmask: reversible pseudonymisation and corpus preparation as Spark jobs."""
