"""Movie, projection, mask, trace, registration and extraction operators."""
