"""Logins in URLs, however long."""

import time

import pytest

from gridloom.llm import secrets


@pytest.mark.parametrize("login", ["user:pass", ":password", "u:" + "a.b-c_" * 40, "x" * 300 + ":" + "y" * 3000])
def test_logins_of_any_length(login):
    text = f"see redis://{login}@host:6379/0 there"
    assert [x for x in secrets.Scanner(secrets.EXTRA).scan([text])[0] if secrets.EXTRA[x[1]].kind == "url_login"] == [(4, secrets.EXTRA.index(next(r for r in secrets.EXTRA if r.kind == "url_login")), 4 + len("redis://") + len(login) + 1)]


def test_no_login_without_a_password_and_in_time():
    scanner = secrets.Scanner(secrets.EXTRA)
    assert scanner.scan(["http://host:80/a@b http://user@host http://user:@host"])[0] == []
    start = time.time()
    assert scanner.scan(["abcdefghijklmnop://" * 20_000 + "x:" * 20_000 + "y" * 200_000])[0] == []
    assert scanner.scan(["a1" * 200_000, "a" * 300_000 + "://x", "-----BEGIN " + "A " * 200_000])[0] == []
    assert time.time() - start < 5


def test_rules_hold_runs_of_any_length():
    found = secrets.Scanner(secrets.EXTRA).scan([f"{'x' * 400}://u:p@host", f"-----BEGIN {'VERY ' * 30}PRIVATE KEY-----"])
    assert [len(x) for x in found] == [1, 1]


def test_repeats_that_stand_for_many_strings():
    """ab, aab, abab ...: strings that several ways of repeating give are all in the query, or there is none."""
    assert secrets._powers(["a", "b"], 3) == {x + y + z for x in "ab" for y in "ab" for z in "ab"}
    assert secrets._powers([str(i) for i in range(10)], 2) is None
    for pattern, texts in (("x(a|aa|aaa){1,4}y", ["x" + "a" * n + "y" for n in range(1, 13)]), ("key([0-9]){0,3}=", ["key=", "key7=", "key123="])):
        query = secrets.trigram_query(pattern)
        segment = secrets.Segment(texts, secrets.trigrams_in(query))
        assert segment.candidates(query) == set(range(len(texts)))
