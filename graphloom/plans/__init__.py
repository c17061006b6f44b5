"""Question analysis and compilation of questions to graph queries."""
