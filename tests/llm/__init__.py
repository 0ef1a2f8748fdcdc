"""Tests of the training-data operators; a package, as names of files may be those of other tests."""
