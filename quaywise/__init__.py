"""Catalogue publish, discover, dispatch and audit jobs as PySpark DataFrame operators."""
