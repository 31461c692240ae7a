"""Table-to-table operators: as-of priors, spine, sessions, ranking, evaluation, training."""
