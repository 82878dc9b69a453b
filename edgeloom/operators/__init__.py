"""Graph, answer, edit, statistics and priority operators over edge tables."""
