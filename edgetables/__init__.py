"""Edge tables in Spark: components, propagation steps, synthetic graphs, run summaries."""

from edgetables.operators.edges import nodes, normalize_edges, shift_ids, symmetrize, union_distinct
from edgetables.operators.pairs import attach_labels, component_map, component_sizes, dedup_pairs, graph_stats
from edgetables.plans.components import component_pairs, connected_components, find_components
from edgetables.plans.diameter import component_diameters, find_diameters
from edgetables.plans.fixed_point import FixedPoint, NotConverged, fixed_point
from edgetables.plans.keys import number_edges, number_keys
from edgetables.plans.steps import step_join, step_list, step_window
from edgetables.sources.edge_lists import edges_from, read_edge_list, read_graph_catalog, write_edge_list
from edgetables.sources.runs import read_runs, write_runs

__all__ = [
    "FixedPoint",
    "NotConverged",
    "attach_labels",
    "component_diameters",
    "component_map",
    "component_pairs",
    "component_sizes",
    "connected_components",
    "dedup_pairs",
    "edges_from",
    "find_components",
    "find_diameters",
    "fixed_point",
    "graph_stats",
    "nodes",
    "normalize_edges",
    "number_edges",
    "number_keys",
    "read_edge_list",
    "read_graph_catalog",
    "read_runs",
    "shift_ids",
    "step_join",
    "step_list",
    "step_window",
    "symmetrize",
    "union_distinct",
    "write_edge_list",
    "write_runs",
]
