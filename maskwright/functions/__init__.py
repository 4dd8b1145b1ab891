"""Column builders: detectors, validators, policy folds, redaction and scalar helpers."""
