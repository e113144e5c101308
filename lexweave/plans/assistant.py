"""Evidence of questions to prompts, and generated answers to replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import links
from ..operators import evidence as ev


def prompts(questions: DataFrame, evidence: DataFrame, documents: DataFrame, base_url: str) -> DataFrame:
    """Refined, deduplicated and hydrated evidence packed into one prompt per question."""
    kept = ev.dedupe_evidence(ev.refine_evidence(evidence))
    hydrated = ev.hydrate_evidence(ev.cap_evidence(kept).drop("n"), documents, base_url)
    return ev.pack_context(questions, hydrated)


def replies(
    questions: DataFrame, answers: DataFrame, evidence: DataFrame, page: int = 1, page_size: int = 10
) -> tuple[DataFrame, DataFrame]:
    """(``question_id, answer``, citations) from raw generated texts ``(question_id, raw)``."""
    parsed = ev.parse_answer_json(answers)
    cleaned = parsed.select("question_id", links.sanitize_answer_links("answer").alias("answer"))
    cited = parsed.select("question_id", F.posexplode("citations").alias("ord", "citation")).select(
        "question_id", "ord", "citation.evidence_id", "citation.quote"
    )
    return cleaned, ev.resolve_citations(questions, cited, evidence, page, page_size)
