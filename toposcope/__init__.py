"""Topic discovery over large text tables, expressed as Spark jobs.

Every public function takes and returns Spark DataFrames. Nothing runs at import.
"""
