"""DataFrame operators: targeting, queue state, upserts, statistics, scoring, traces."""
