"""DataFrame -> DataFrame operators: relations, index, retrieval, negatives, splits, evaluation."""
