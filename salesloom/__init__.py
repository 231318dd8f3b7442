"""Retail sales analytics written as Spark DataFrame, SQL, ML and streaming jobs."""

from salesloom.operators.enrich import join_category_stock, join_sku_stock
from salesloom.operators.features import engineer_features
from salesloom.operators.persistence import load_bundle, save_bundle
from salesloom.operators.reports import (
    cancellation_model,
    dashboard,
    explorer,
    segmentation,
)
from salesloom.operators.rfm import compute_rfm
from salesloom.operators.scoring import score_requests
from salesloom.operators.segments import segment_customers
from salesloom.operators.sqllib import TEMPLATES, run_template, run_user_sql
from salesloom.operators.stats_tests import hypothesis_tests
from salesloom.operators.training import compare_models, train_and_evaluate
from salesloom.sources.csv_tables import load_and_clean
from salesloom.sources.sinks import register_tables

__all__ = [
    "TEMPLATES", "cancellation_model", "compare_models", "compute_rfm", "dashboard",
    "engineer_features", "explorer", "hypothesis_tests", "join_category_stock",
    "join_sku_stock", "load_and_clean", "load_bundle", "register_tables", "run_template",
    "run_user_sql", "save_bundle", "score_requests", "segment_customers", "segmentation",
    "train_and_evaluate",
]
