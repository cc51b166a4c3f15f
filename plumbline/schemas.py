"""The model's tables."""

from __future__ import annotations

#: Names and types of the model.
TABLES = {
    "sources": "source_id long, name string, base_url string, created_at timestamp, type string, is_active boolean",
    "ingestion_logs": "log_id long, ingestion_type string, status string, message string, created_at timestamp, source_id long",
    "news_raw": "news_raw_id long, source_id long, log_id long, platform string, source_account string, original_url string, title_raw string, content_raw string, author_raw string, published_at timestamp, scraped_at timestamp, status string",
    "news_processed": "news_processed_id long, news_raw_id long, source_id long, clean_text string, language string, token_count int, processed_at timestamp, status string",
    "processing_logs": "news_processed_id long, stage string, status string, message string, created_at timestamp, model_version string, execution_time_ms long",
    "news_clusters": "cluster_id long, representative_id long, source_id long, created_at timestamp, cluster_score double",
    "cluster_members": "news_processed_id long, cluster_id long, source_id long",
    "ml_predictions": "representative_id long, sentiment_label string, sentiment_score double, model_version string, created_at timestamp, fake_score double, fake_label string, fake_bucket string, raw_probabilities string",
    "summaries": "representative_id long, summary_text string, model_version string, created_at timestamp",
    "users": "user_id long, username string, email string, role string, created_at timestamp",
    "news": "news_id long, representative_id long, source_id long, title string, summary string, original_url string, sentiment_label string, sentiment_score double, fake_score double, published_at timestamp",
    "news_views": "view_id long, user_id long, news_id long, viewed_at timestamp, time_spent_sec int",
    "news_clicks": "click_id long, user_id long, news_id long, clicked_at timestamp",
    "news_reactions": "user_id long, news_id long, reaction int, created_at timestamp",
    "evidence_cache": "prediction_id long, report string, generated_at timestamp",
}
