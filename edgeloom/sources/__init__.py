"""Readers of project text, manifests, questions and edge tables."""
