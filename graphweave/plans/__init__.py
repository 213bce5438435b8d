"""Plans that take several Spark jobs: fix points, and what they need between the jobs."""
