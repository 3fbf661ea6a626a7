"""Pattern mining, similarity, recommendation, graph, stream and cluster operators as Spark DataFrame programs."""

__version__ = "0.1.0"
