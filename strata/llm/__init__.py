"""Operations of a training-data pipeline: dedup, decontamination, language, packing, tokens."""
