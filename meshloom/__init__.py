"""Mesh analytics on Spark DataFrames: surfaces and hexahedral volumes as tables of vertices, faces and cells."""
