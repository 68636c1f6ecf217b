"""Operations by name: what may be called is registered, with what it can do; nothing else is."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.operators import diff, graph, inventory, records, review, rules, sensitive, structure, text


class Operation(NamedTuple):
    group: str
    name: str
    run: Callable
    supported: bool = True


_GROUPS = {
    "text": (text, ("pages_of", "match_rows", "term_frequency", "document_frequency", "top_terms", "sentences", "summary", "ask", "extracted", "unknown_words", "spelling_findings", "export_text")),
    "structure": (structure, ("line_roles", "bookmarks", "form_values", "label_candidates", "field_types", "accessibility_cues", "reflow_blocks", "snippets", "citations", "common_terms")),
    "sensitive": (sensitive, ("kinds", "report", "findings", "payment_cards")),
    "diff": (diff, ("page_diffs", "diff_rows", "diff_totals", "comparison_report")),
    "records": (records, ("matching", "keyed_diff", "histograms", "legend", "section_ends", "runs", "numbered", "page_labels", "tree_parents", "chained_log", "verified_chain")),
    "review": (review, ("paired_pages", "pair_totals", "calculated", "form_errors", "takeoff", "submissions", "transitions", "cover")),
    "inventory": (inventory, ("selected", "lookup", "chosen", "unembedded", "font_evidence", "empty_pages", "due", "manifest", "residue", "listed")),
    "rules": (rules, ("preflight", "rolled_up", "tag_summary", "accessibility", "issues", "workflow", "intents")),
    "graph": (graph, ("reached", "reachability", "inherited", "dependency_order", "missing_parents", "depth_faults")),
}
OPERATIONS: dict[str, Operation] = {f"{g}.{n}": Operation(g, n, getattr(m, n)) for g, (m, names) in _GROUPS.items() for n in names}
#: Operations that are known and refused: they would sign, send or run what others wrote.
OPERATIONS |= {f"{g}.{n}": Operation(g, n, lambda *a, **k: None, False) for g, n in (("signing", "certificate"), ("sharing", "send"), ("plugins", "run"))}


def register(group: str, name: str, run: Callable) -> None:
    """Add an operation; a name that is there is not replaced."""
    if f"{group}.{name}" in OPERATIONS:
        raise ValueError(f"{group}.{name} is registered")
    OPERATIONS[f"{group}.{name}"] = Operation(group, name, run)


def deliver(operation: str, *args, **options):
    """Run an operation by its name."""
    found = OPERATIONS.get(operation)
    if found is None:
        raise KeyError(f"unknown operation {operation}")
    if not found.supported:
        raise PermissionError(f"{operation} is not supported")
    return found.run(*args, **options)


def detected(pages: DataFrame, detector: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The report of a detector of one's own: it gives doc_id, page, start, end, kind and label for pages; rows outside their
    page, or without a kind, are refused as an error when they are read."""
    found = detector(pages)
    if missing := {"doc_id", "page", "start", "end", "kind", "label"} - set(found.columns):
        raise ValueError(f"the detector gives no {', '.join(sorted(missing))}")
    size = pages.select("doc_id", "page", F.length("text").alias("_n"))
    each = found.join(size, ["doc_id", "page"], "left")
    good = F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("_n")) & (F.col("kind") != ""), F.lit(False))
    checked = each.withColumn("kind", F.when(good, F.col("kind")).otherwise(F.raise_error(F.lit("the detector gave a match outside its page"))))
    return sensitive.report(checked.drop("_n"))
