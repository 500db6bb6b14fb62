"""DataFrame operators: row ladders, text chains, dataset operations, checks, review, audio."""
