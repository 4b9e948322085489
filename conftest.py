"""Makes the repository's top folder importable in tests."""
