"""Query plans: derived views, DuckDB twins and the registered queries."""

import importlib

MODULES = ["q_models", "q_dataset", "q_splits", "q_sizes", "q_metrics", "q_text", "q_similarity", "q_cascade", "q_encoders", "q_reports", "q_files"]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"sectio.plans.{m}")
