"""Retail analytics and table loads on Spark."""
