"""The core's queries, by area."""

from . import cell_queries, event_queries, flow_queries, glossary_queries, memory_queries, text_queries

MODULES: list = [memory_queries, glossary_queries, text_queries, event_queries, cell_queries, flow_queries]
