"""pageloom: web-page analytics over page snapshots, written as Spark jobs."""

__version__ = "0.1.0"
