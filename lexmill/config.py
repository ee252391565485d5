"""All tunable constants in one place; operators take them from here or as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # chunking and ingest
    chunk_tokens: int = 300
    overlap_tokens: int = 50
    max_upload_bytes: int = 20 * 1024 * 1024
    min_page_chars: int = 25
    min_total_chars: int = 20
    ocr_page_budget: int = 40
    ocr_min_confidence: float = 0.5
    ocr_good_confidence: float = 0.75
    # analysis
    summary_sentences: int = 5
    keywords: int = 15
    min_topics: int = 2
    max_topics: int = 8
    topic_terms: int = 6
    keyword_weights: dict = field(default_factory=lambda: {"tfidf": 0.4, "rake": 0.3, "yake": 0.3})
    importance_weights: dict = field(
        default_factory=lambda: {"tfidf": 0.25, "heading": 0.15, "definition": 0.2, "numeric": 0.1, "position": 0.1, "textrank": 0.2}
    )
    # retrieval
    alpha: float = 0.4
    top_k_knowledge: int = 8
    top_k_exam: int = 5
    exam_relevance_weight: float = 0.6
    exam_importance_weight: float = 0.4
    exam_candidate_multiplier: int = 3
    min_relevance_ratio: float = 0.10
    sufficient_cosine: float = 0.25
    sufficient_coverage: float = 0.5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    # routing
    router_rule_confidence: float = 0.95
    router_min_probability: float = 0.45
    # chat
    history_messages: int = 6
    history_chars: int = 1500
    snippet_chars: int = 240
    # assessment
    max_questions: int = 20
    default_questions: int = 5
    pool_cap: int = 8
    short_correct: float = 0.6
    short_partial: float = 0.3
    weak_threshold: float = 0.6
    # research and resources
    research_sources: int = 6
    research_queries: int = 3
    query_words: int = 8
    video_weights: dict = field(default_factory=lambda: {"title": 0.4, "views": 0.25, "recency": 0.2, "duration": 0.15})
    video_min_minutes: float = 5
    video_max_minutes: float = 40
    video_results: int = 6


SETTINGS = Settings()
