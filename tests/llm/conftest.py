from __future__ import annotations

import pytest

from quillstone.llm import bitplanes, exchange, packing


@pytest.fixture(autouse=True)
def few_pieces(monkeypatch):
    """Small inputs in fewer pieces than a cluster's least, but still in several."""
    monkeypatch.setattr(exchange, "LEAST_BUCKETS", 24)
    monkeypatch.setattr(bitplanes, "LEAST_FILES", 6)
    monkeypatch.setattr(packing, "LEAST_SHARDS", 6)
