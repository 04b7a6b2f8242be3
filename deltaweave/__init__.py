"""Binary-delta analytics on Spark: chunk, fingerprint, match, encode, patch."""
