"""Ordered-stream and ring-inspection analytics on PySpark."""

from ringsight.session import build_session, checkpoint_root, settle

__all__ = ["build_session", "checkpoint_root", "settle"]
