"""What operators raise."""


class GraphError(Exception):
    """Base of the library's errors."""


class InvalidNode(GraphError):
    pass


class DAGWouldCycle(GraphError):
    pass


class DAGHasCycle(GraphError):
    pass


class NoEdgeBetweenNodes(GraphError):
    pass


class NoSuitableNeighbors(GraphError):
    pass


class NullGraph(GraphError):
    pass


class NoPathFound(GraphError):
    pass


class InvalidMapping(GraphError):
    pass


class JSONSerializationError(GraphError):
    pass


class JSONDeserializationError(GraphError):
    pass


class NegativeCycle(GraphError):
    pass


class FailedToConverge(GraphError):
    pass


class GraphNotBipartite(GraphError):
    pass
