"""Typed readers, sinks and assertion operators."""
