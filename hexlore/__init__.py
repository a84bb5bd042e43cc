"""Spatial feature engineering, clustering, classification and risk scoring as Spark DataFrame operations."""
