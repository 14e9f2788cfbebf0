"""verigrain: identity-risk analytics expressed as PySpark DataFrame plans."""
