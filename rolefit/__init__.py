"""rolefit: job postings, candidate profiles and their matching as Spark jobs."""
