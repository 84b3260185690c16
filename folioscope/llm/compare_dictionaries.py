"""Compares the two kinds of dictionaries of the abuse model on labels: ``python -m folioscope.llm.compare_dictionaries DIR``.

DIR holds the tables documents and review_labels. Each half of the labels is scored by a model of the other half;
printed are F1 at the best common threshold, and F1 of each half at the threshold of the other.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from folioscope.llm import abuse
from folioscope.runtime import table


def counts(histogram: list[tuple[float, int, int, int]], at: float) -> tuple[int, int, int]:
    """Hits, false ones and missed ones from the score ``at`` on."""
    hits, false = (sum(n for s, k, _, n in histogram if k == kind and s >= at) for kind in (1, 0))
    return hits, false, sum(n for _, k, _, n in histogram if k) - hits


def f1(hits: int, false: int, missed: int) -> float:
    return 2 * hits / max(1, 2 * hits + false + missed)


def main(folder: str) -> None:
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    known, sizes = abuse.labelled(table(spark, folder, "documents"), table(spark, folder, "review_labels"), "doc_id", "text", "abusive")
    for kind, trained in (("content", False), ("trained", True)):
        model, histogram = abuse.calibrated(known, sizes, trained)
        all_in = counts(histogram, model.threshold)
        crossed = [0, 0, 0]
        for fold in (0, 1):
            at = abuse.threshold([(s, k, n) for s, k, f, n in histogram if f != fold])
            crossed = [a + b for a, b in zip(crossed, counts([h for h in histogram if h[2] == fold], at), strict=True)]
        print(f"{kind}: threshold {model.threshold:.2f}, hits, false, missed {all_in}, F1 {f1(*all_in):.3f}; F1, threshold from the other half {f1(*crossed):.3f}; dictionaries {len(model.ordinary)}, {len(model.abusive)} bytes")


if __name__ == "__main__":
    main(sys.argv[1])
