"""graphloom: a Spark-first engine for typed property graphs and the text around them."""

__version__ = "0.1.0"
