"""Relational operators: every public function takes and returns DataFrames."""
