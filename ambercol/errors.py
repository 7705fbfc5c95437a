"""One shape for every refusal: what is wrong and how to mend it."""

from __future__ import annotations


def fail(op: str, what: str, fix: str) -> ValueError:
    """The error to raise: ``raise fail("group", "key 'plan' holds 2 NULLs.", "filter them first.")``."""
    return ValueError(f"{op}: {what} Fix: {fix}")
