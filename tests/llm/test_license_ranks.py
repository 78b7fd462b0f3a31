"""Licenses whose template ranks low in a long line of prose."""

import random

from corpusmill.llm import license_scan


def test_low_ranks_are_confirmed():
    """Among thousands of words a short notice saves less than long templates do; it is still found, once and exactly."""
    rng = random.Random(3)
    vocabulary = " ".join(license_scan.TEMPLATES.values()).split() + [f"w{i}" for i in range(300)]
    scanner, ranks = license_scan.Scanner(license_scan.TEMPLATES), []
    for name in ("Apache-2.0 line", "MIT line", "CC-BY-NC-4.0 line", "All rights reserved", "CC0-1.0 line"):
        prose = [rng.choice(vocabulary) for _ in range(3000)]
        text = " ".join([*prose[:1700], license_scan.TEMPLATES[name], *prose[1700:]])
        found = [r for r in scanner.scan(text) if r["license"]]
        assert [(r["license"], r["n_missing"]) for r in found] == [(name, 0)]
        ranks.append(found[0]["rank"])
    assert max(ranks) > 4


def test_templates_without_a_common_cue():
    """Cues come from the templates, so that any text that can be confirmed is looked at."""
    rng = random.Random(9)
    templates = {"animals": "zebra quagga okapi gnu kudu eland nyala bongo oribi topi", "long": " ".join(f"term{i}" for i in range(60))}
    scanner = license_scan.Scanner(templates)
    for name, words in ((n, t.split()) for n, t in templates.items()):
        for _ in range(20):
            left = list(words)
            for i in rng.sample(range(len(words)), len(words) * license_scan.ALLOWED // 100):
                left[i] = "other"
            assert [r["license"] for r in scanner.scan(f"some prose\n{' '.join(left)}\nmore") if r["license"]] == [name]
    assert not [r for r in scanner.scan("a license of another kind") if r["license"]]


def test_a_license_across_the_cut_of_a_long_block():
    """Runs of cue lines are cut at BLOCK_LINES; a license on both sides of the cut is found once."""
    mit = license_scan.TEMPLATES["MIT"].split()
    lines = ["a license line"] * (license_scan.BLOCK_LINES - 8) + [" ".join(["licensed", *mit[i : i + 10]]) for i in range(0, len(mit), 10)] + ["a license line"] * 90
    found = [r for r in license_scan.Scanner(license_scan.TEMPLATES).scan("\n".join(lines)) if r["license"]]
    assert [(r["license"], r["n_missing"]) for r in found] == [("MIT", 0)]


def test_licenses_that_differ_in_a_word():
    t = license_scan.TEMPLATES
    scanner = license_scan.Scanner(t)
    for name in ("GPL-2.0 notice", "GPL-3.0 notice", "LGPL-2.1 notice", "AGPL-3.0 notice", "BSD-2-Clause", "BSD-3-Clause"):
        found = [r for r in scanner.scan(f"some text\n{t[name]}\nmore text") if r["license"]]
        assert [(r["license"], r["n_missing"], r["n_other"]) for r in found] == [(name, 0, 0)]
