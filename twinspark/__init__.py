"""twinspark: similarity search and near-duplicate detection as Spark plans."""
