"""lattica: a Spark-first analytics engine over corpora of semi-structured asset documents."""

__version__ = "0.1.0"
