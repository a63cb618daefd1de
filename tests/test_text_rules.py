"""Text functions on literal cases, where Java's and the rules' own semantics differ."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomline.functions import identity, prompts, statements, text
from loomline.operators import commands


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("o")).first().o


@pytest.fixture(autouse=True)
def column(spark):
    """The tested column, which only exists while a session does."""
    global t
    t = F.col("t")


@pytest.mark.parametrize(
    ("value", "pattern", "found"),
    [("éfixed", r"\bfixed\b", True), ("fixedé", r"\bfixed\b", True), ("unfixed", r"\bfixed\b", False), ("abc\n", "abc$", False), ("abc", "^ABC$", True)],
)
def test_rules_have_ascii_edges_and_true_ends(spark, value, pattern, found):
    assert one(spark, text.matches(t, pattern), value) is found


def test_white_space_is_unicodes(spark):
    assert one(spark, text.trimmed(t), "\u00a0 a\u2028b \ufeff") == "a\u2028b"
    assert one(spark, text.squeezed(t), " a\u00a0\n b ") == "a b"
    assert one(spark, text.filled(t), " \u3000 ") is None


def test_shortening(spark):
    assert one(spark, text.shortened(t, 10), "abcdef ghijkl") == "abcdef..."
    assert one(spark, text.shortened(t, 10, trim_cut=False), "abcdef ghijkl") == "abcdef ..."
    assert one(spark, text.shortened(t, 20), " a  b ") == "a b"
    assert one(spark, text.head_and_tail(t, 35), "a" * 30 + " " + "b" * 30) == "a" * 10 + " ... " + "b" * 20


def test_excerpt_shows_the_match(spark):
    long = "x " * 400 + "it failed here " + "y " * 400
    out = one(spark, text.excerpt_around(t, r"\bfailed\b", 240), long)
    assert "failed" in out and len(out) <= 240 and out.startswith("...") and out.endswith("...")
    assert one(spark, text.excerpt_around(t, r"\bfailed\b", 240), "  it  failed ") == "it failed"
    lines = "first line\n" * 30 + "second failed\n" + "z " * 200
    assert one(spark, text.excerpt_around(t, r"\bfailed\b", 100), lines).startswith("...second failed")


@pytest.mark.parametrize("value", ["é" * 400, "日本" * 300, "a" * 600, "👍" * 200, "short"])
def test_byte_cap_cuts_between_characters(spark, value):
    out = one(spark, text.capped_bytes(t), value)
    assert len(out.encode()) <= 512 and (out == value or out.endswith("…")) and value.startswith(out.rstrip("…"))


def test_prompts(spark):
    assert one(spark, prompts.cleaned_prompt(t), "<system-reminder>x</system-reminder>do it <b>now</b>") == "do it  now"
    assert one(spark, prompts.cleaned_prompt(t), "a <user_query> fix\nthis </user_query> b") == "fix\nthis"
    assert one(spark, prompts.substantive(t), "# AGENTS.md\nCaveat: no\nfix the parser") == "fix the parser"
    assert one(spark, prompts.substantive(t), "# AGENTS.md") is None
    for said, quiet in (("hello!", True), ("thanks", True), ("fix the failing build please", False), ("You are a helpful assistant for x", True), ("", True), ("explain how the retry logic of this module works in detail", False)):
        assert one(spark, prompts.no_signal(t), said) is quiet, said


@pytest.mark.parametrize(
    ("value", "said"),
    [
        ("## Head\nUse **bold** and _this_ [link](http://x)", "Head Use bold and this link"),
        ("before\n| a | b |\n|---|---|\n| 1 | 2 |", "before"),
        ("- one\n* two", "one two"),
        ("```\ncode\n```\nrest", "rest"),
        ("Verified: it works", "it works"),
    ],
)
def test_statements_lose_markdown(spark, value, said):
    assert one(spark, prompts.cleaned_statement(t), value) == said


def test_chatter_and_sentences(spark):
    assert one(spark, prompts.has_chatter(t), "ok\nLet me check the file") is True
    assert one(spark, prompts.has_chatter(t), "I'll say it is fixed") is False
    assert one(spark, prompts.atomic(t), "One. Two.") is False and one(spark, prompts.atomic(t), "v1.2 works; verified.") is True


def test_error_signatures(spark):
    for said, want in (("EXPECTED but ENOENT", "ENOENT"), ("a TypeError: x", "TypeError"), ("exited with status code 3", "exit code 3"), ("exit code 12", "exit code 12"), ("fine", None)):
        assert one(spark, statements.error_signature(t), said) == want


def test_resolutions(spark):
    assert one(spark, statements.fix_statement(t), "Fixed fixed the parser.") == "Fixed the parser"
    assert one(spark, statements.resolution(t), "...Verification noted: done!") == "Verification noted: done"
    assert one(spark, statements.tried_approach(t), "tried to patch the loader but gave up") == "patch the loader"
    assert one(spark, statements.repo_path(t), "`/Users/a/Code/repo/src/x.py`") == "src/x.py"


def test_commands(spark):
    for said, want in (("`npm test.`", "npm test"), ("git", None), ("GIT", None), ("td-1a2b3c", None), ("td add x", "td add x"), ("ls", "ls"), ("make all\nmore", "make all"), ("hello", None), ("./run.sh  a", "./run.sh a")):
        assert one(spark, commands.normal(t), said) == want, said
    assert one(spark, commands.paths_in(F.array(t)), "see /home/a/b.py and C:\\x\\y") == ["/home/a/b.py", "C:\\x\\y"]


def test_keys(spark):
    key = one(spark, identity.canonical_key(t, F.lit("")), "Running the tests")
    assert key == one(spark, identity.canonical_key(F.lit(""), t), "test: runn") == "runn-test"
    assert one(spark, identity.slug(t), "the big big dog and a cat") == "big-dog-cat"
    assert one(spark, identity.normal_remote(t), "git@GitHub.com:Some/Repo.git") == one(spark, identity.normal_remote(t), "https://github.com/some/repo/") == "github.com/some/repo"
    made = one(spark, identity.record_id(F.lit("when x"), t), "word " * 40)
    assert len(made) <= 80 and made.startswith("word-")
