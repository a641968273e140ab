"""Pipelines: registered operators composed to graphs, stages, configuration and the command line."""
