"""Jobs that combine operators: scoring, training, experiments, retraining, query catalogue."""
