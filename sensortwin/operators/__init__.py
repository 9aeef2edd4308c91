"""DataFrame operators: layers, gold aggregates, serving, graph, what-if, alarms."""
