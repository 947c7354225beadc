"""weftgraph: a code-graph analytics engine written for Spark."""
