"""End-to-end recommendation (O9) and its options.

The class table is written once to the shared checkpoint folder (lineage
cut, survives executor loss) and every later stage reads that table, so the
regex extraction runs exactly once however many branches consume it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from ..functions import constants as C
from ..operators import graph as G
from ..operators import placement as PL
from ..operators.vectors import type_vectors_literal
from ..session import materialize


@dataclass
class Analysis:
    classes: DataFrame
    edges: DataFrame | None
    scored: DataFrame
    suggestions: DataFrame
    results: DataFrame


def analyze(classes: DataFrame, class_vec: DataFrame | None = None, type_vec: DataFrame | None = None,
            use_embeddings: bool = True, use_dependencies: bool = True,
            max_classes: int | None = None, store: bool = True) -> Analysis:
    """Run detection and suggestion; lazy but for the class table, which ``store`` writes once."""
    if max_classes is not None:
        classes = PL.limit_classes(classes, max_classes)
    if store:
        classes = materialize(classes, "classes")
    edge_df = G.edges(classes) if use_dependencies else None
    emb = None
    if use_embeddings and class_vec is not None and type_vec is not None:
        emb = PL.embedding_scores(class_vec, type_vectors_literal(type_vec))
    scored = PL.scored_rows(classes, edge_df, emb)
    sugg = PL.suggestions(scored)
    results = PL.assemble_results(classes, sugg)
    return Analysis(classes, edge_df, scored, sugg, results)


def recommend(classes: DataFrame, class_vec: DataFrame | None = None, type_vec: DataFrame | None = None,
              confidence: float = C.CLI_CONFIDENCE_DEFAULT, **kw) -> DataFrame:
    """O9 (+O3): the result table, with the confidence filter applied."""
    res = analyze(classes, class_vec, type_vec, **kw).results
    return PL.apply_confidence_threshold(res, confidence)


def recommend_with_metadata(classes: DataFrame, class_vec=None, type_vec=None, **kw) -> DataFrame:
    """O2: materialise the results, then stamp the measured run time and a timestamp."""
    start = time.time()
    kw.setdefault("store", False)
    res = materialize(recommend(classes, class_vec, type_vec, **kw), "results")
    return PL.with_run_metadata(res, time.time() - start, datetime.now(timezone.utc).replace(tzinfo=None).isoformat())
