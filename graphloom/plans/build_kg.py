"""Records to a knowledge graph: modules, concepts, COVERS, RELATED, PREREQ, importance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import concepts as C
from ..operators import graph as G
from ..operators.tables import passing, reliable
from ..params import PREREQ_PATTERNS, SETTINGS
from ..plugins import keywords


@dataclass(frozen=True)
class Graph:
    modules: DataFrame
    concepts: DataFrame
    edges: DataFrame


def candidates(records: DataFrame, per_record: int = 20, limit: float = 0.7) -> DataFrame:
    """module_id, name, key_term: keywords of up to three words of each record (id, module_id, text), and its key terms
    where it has some."""
    found = keywords(records, "id", "text", per_record, 3, limit).join(records.select("id", "module_id"), "id").select("module_id", "name", F.lit(False).alias("key_term"))
    if "key_terms" in records.columns:
        found = found.unionByName(records.select("module_id", F.explode("key_terms").alias("name"), F.lit(True).alias("key_term")))
    return C.clean_names(found).groupBy("module_id", "name").agg(F.bool_or("key_term").alias("key_term"))


def prerequisites(records: DataFrame, concepts: DataFrame) -> DataFrame:
    """PREREQ edges (source, target, type, weight, confidence, evidence) of records (id, text) by phrases.

    The target is the concept that the phrase's object is, or the first (in the order of concepts) that contains it or
    is contained in it; the source the first other concept before the phrase.  concepts is a top list.
    """
    import re

    order = [F.desc("n"), F.desc(F.length("name")), F.col("name")] if "n" in concepts.columns else [F.col("name")]
    names = [r.name for r in concepts.orderBy(*order).select("name").collect()]
    patterns = [re.compile(p, re.IGNORECASE) for p in PREREQ_PATTERNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = {n.lower(): n for n in names}
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                for p in patterns:
                    for m in p.finditer(text or ""):
                        said, before = m.group(1).strip().lower(), text[: m.start()].lower()
                        target = lookup.get(said) or next((n for low, n in lookup.items() if low in said or said in low), None)
                        source = target and next((n for low, n in lookup.items() if low in before and n != target), None)
                        if source:
                            out.append((source, target, text[max(0, m.start() - 50) : m.end() + 20]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(3)], ["source", "target", "evidence"])

    found = records.select("text").mapInArrow(run, "source string, target string, evidence string")
    return found.groupBy("source", "target").agg(F.min("evidence").alias("evidence")).select("source", "target", F.lit("PREREQ").alias("type"), F.lit(0.8).alias("weight"), F.lit(0.6).alias("confidence"), "evidence")


def build(records: DataFrame, threshold: int = SETTINGS.related_threshold, top: int = SETTINGS.max_concepts, iterations: int = 100) -> Graph:
    """The graph of records (id, module_id, text, and key_terms where there are some)."""
    with passing(records.sparkSession) as keep:
        found = reliable(candidates(records))
        kept = reliable(C.most_common(C.drop_substrings(found.select("name").distinct()).join(found, "name").select("name"), top))
        nodes = reliable(C.document_frequency(found.join(kept.select("name"), "name", "left_semi")))
        inside = C.mentions(records, kept, "id")
        related = G.related(inside, "id", "name", threshold).select("source", "target", "type", "weight", "confidence")
        pre = prerequisites(records, kept).select("source", "target", "type", "weight", "confidence")
        covers = G.covers(found.join(kept.select("name"), "name", "left_semi"), kept).select("source", "target", "type", F.lit(1.0).alias("weight"), F.lit(0.9).alias("confidence"))
        edges = keep(reliable(related.unionByName(pre).unionByName(covers)))
        ranks = G.pagerank(nodes, edges, iterations)
        return Graph(records.select("module_id").distinct(), keep(nodes.join(ranks.select("name", "importance"), "name")), edges)


def statistics(graph: Graph) -> DataFrame:
    return G.statistics(graph.edges, concepts=graph.concepts, modules=graph.modules)
