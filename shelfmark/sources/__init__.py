"""Readers of raw inputs."""
