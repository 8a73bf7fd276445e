"""Whole runs: prepare a corpus, sweep the number of topics, describe topics."""
