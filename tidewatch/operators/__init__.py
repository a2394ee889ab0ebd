"""DataFrame operators: first-seen filters, running maxima, poll and record operators."""
