"""A PySpark analytics engine for news veracity: text kernels, clustering, claims, scoring, evaluation."""
