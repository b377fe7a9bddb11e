"""Wrappers: constant blocks of any length are template, and every layout of a host has its own."""

import pytest

from tests.llm.fixtures import words
from weftline.llm import wrapper


def pages(spark, made):
    return spark.createDataFrame([(k, "http://a.example/x", html) for k, html in enumerate(made)], "page_id long, url string, html string")


@pytest.mark.parametrize("small", [wrapper.SMALL, -1])
def test_long_constant_block(spark, monkeypatch, small):
    monkeypatch.setattr(wrapper, "SMALL", small)
    terms = words(1, 150)
    assert len(terms) > 400
    texts = [words(10 + k, 60) for k in range(8)]
    found = wrapper.extract_main_text(pages(spark, [f"<html><body><div class=a><p>{t}</p></div><div class=b>{terms}</div></body></html>" for t in texts])).collect()
    assert {r.page_id: r.text for r in found} == dict(enumerate(texts))


@pytest.mark.parametrize("small", [wrapper.SMALL, -1])
def test_two_layouts(spark, monkeypatch, small):
    monkeypatch.setattr(wrapper, "SMALL", small)
    texts = [words(30 + k, 60) for k in range(12)]
    one, two = words(2, 20), words(3, 20)
    made = [
        f"<html><body><div class=a><div class=x>{one}</div><p>{t}</p></div></body></html>" if k % 3 else f"<html><body><section><section class=y>{two}</section><p>{t}</p></section></body></html>"
        for k, t in enumerate(texts)
    ]
    found = wrapper.extract_main_text(pages(spark, made)).collect()
    assert {r.page_id: r.text for r in found} == dict(enumerate(texts))
