"""postmill: licensed-employer and job-posting analytics as PySpark DataFrame jobs."""
