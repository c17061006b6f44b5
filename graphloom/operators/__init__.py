"""Graph, relational and skew-aware operators."""
