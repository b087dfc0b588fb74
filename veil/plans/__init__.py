"""Plan-level building blocks: the immutable ``Release`` handle over a paired frame, the
in-place ``Workspace`` facade, range-partitioned ranking and plan inspection helpers."""
