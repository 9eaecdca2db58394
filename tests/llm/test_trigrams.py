"""A text with a match always meets the trigram query of the pattern."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from gridweave.llm.secret_scan import RULES
from gridweave.llm.trigrams import query

PATTERNS = [r.pattern for r in RULES] + ["abcd", "ab(c|d)e+fgh", "x?yz1", "(foo|bar)baz", "a.c", "(?:abc){2}d*", "[xy]abc|zz", "abc|def", "(ab+c)def", "a{3}b?"]


def meets(text, clauses):
    low = text.lower()
    return all(any(all(t in low for t in some) for some in clause) for clause in clauses)


@pytest.mark.parametrize("pattern", PATTERNS)
def test_matches_meet_the_query(pattern):
    clauses = query(pattern)

    @settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern)))
    def holds(text):
        assert meets(text, clauses)

    holds()


def test_queries():
    assert query("[0-9a-f]{16,}") == [] and query("ab") == [] and query("(abc)*") == []
    assert query("abcd") == [(frozenset({"abc", "bcd"}),)]
    assert set(query("ABC|xyz")[0]) == {frozenset({"abc"}), frozenset({"xyz"})}
    assert not meets("tok en", query(RULES[0].pattern)) and meets("my TOKEN", query(RULES[0].pattern))
