"""pagetrail: Spark-first data jobs for following long sequential texts through recordings and transcripts."""
