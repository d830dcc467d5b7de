"""quern: findings analytics and corpus preparation as Spark jobs."""
