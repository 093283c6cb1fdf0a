"""Crawl-to-catalog jobs for recipe pages, written as Spark DataFrame functions."""
