"""Plans that combine operators: the synthetic corpus, quality and latency reports, and the query catalogue."""
