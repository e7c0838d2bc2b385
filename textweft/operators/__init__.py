"""Tokens, fingerprints, ignore rules, matches and metrics as DataFrame operators."""
