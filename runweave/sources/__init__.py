"""Test-selection sources, readers and stores."""
