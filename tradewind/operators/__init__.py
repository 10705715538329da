"""DataFrame -> DataFrame building blocks (folds, rules, rollups, searches)."""
