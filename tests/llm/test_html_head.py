"""Main text (8) of pages whose head has no end tag."""

import pytest

from formloom.llm.html import blocks_of

TEXT = "A first sentence of the article, long enough."


@pytest.mark.parametrize("body", ["<body><p>", "<p>", "<div><p>", ""])
def test_head_without_end(body):
    page = f"<html><head><title>T</title><meta charset=utf-8><noscript><p>hidden</p></noscript>{body}{TEXT}</p></html>"
    assert [b.text for b in blocks_of(page)] == [TEXT]
