"""benchloom: a PySpark engine for evaluating image-to-video models and curating their data."""
