"""Operations of a training-data pipeline: deduplication, classifiers, scans, search, mixing and packing."""
