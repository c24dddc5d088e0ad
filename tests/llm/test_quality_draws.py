"""Verdicts of the quality rules against a plain re-computation, and copies that are one draw."""

from __future__ import annotations

import random

import pytest

from helioframe.llm import quality_rules as rules


def corpus(n, rng):
    """Good texts, a part of them with symbols, and bad ones full of symbols; per stratum enough labels for a cutoff."""
    docs, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        if bad:
            words += ["#"] * rng.randrange(40, 90)
        elif i % 50 == 1:
            words += ["#"] * 4
        docs.append((i, " ".join(words), "en" if i % 4 else "xx"))
        labels.append((i, int(not bad)))
    return docs, labels


def plain_verdicts(docs, labels):
    """Statistics, ladder and verdicts by loops; only the symbol statistic can exceed a cutoff in these texts."""
    label, stat, draws = dict(labels), {}, {}
    for i, text, lang in docs:
        words = text.split()
        stat[i] = 100 * words.count("#") / len(words)
        draws.setdefault((lang if lang in rules.STRATA else "other", text), [stat[i], 1])[1] &= label[i]
    kept = {}
    for name in ("en", "other"):
        good = [x for (g, _), (x, ok) in draws.items() if g == name and ok]
        cut = None
        for stat_name, bound in rules.ladder():
            bounds = {} if cut is None else {"symbols_per_100": cut}
            if stat_name == "symbols_per_100":
                bounds["symbols_per_100"] = bound
            k = sum(x > bounds.get("symbols_per_100", 1e9) for x in good)
            if not rules.admissible(k, len(good), rules.FALSE_REJECTION, rules.RISK / 5):
                break
            cut = bounds.get("symbols_per_100", cut)
        for i, _, lang in docs:
            if (lang if lang in rules.STRATA else "other") == name:
                kept[i] = cut is None or stat[i] <= cut
    return kept


@pytest.mark.parametrize("n", [300, 1600])
def test_verdicts_equal_a_plain_computation(spark, n):
    docs, labels = corpus(n, random.Random(n))
    got = rules.quality_verdicts(
        spark.createDataFrame(docs, "doc_id int, text string, lang string"), spark.createDataFrame(labels, "doc_id int, quality int")
    ).collect()
    want = plain_verdicts(docs, labels)
    # Repeats within a text fail the base rule; words are random, so only the runs of symbols repeat.
    assert {r.doc_id: r.kept or r.base_failed for r in got} == {i: k or next(r.base_failed for r in got if r.doc_id == i) for i, k in want.items()}
    assert any(not r.kept and not r.base_failed for r in got) == (n > 1000)


def test_copies_of_one_good_text_are_one_draw(spark):
    text = " ".join(f"w{i}" for i in range(80))
    schema = "doc_id int, text string, lang string"
    for docs in ([(1, text, "en")] * 300, [(i, text, "en") for i in range(300)]):
        frame = spark.createDataFrame(docs, schema)
        labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id int, quality int")
        out = rules.quality_verdicts(frame, labels).collect()
        assert len(out) == 300 and all(r.cutoffs is None and r.kept for r in out)
        assert rules.kept_documents(frame, labels).count() == 300
    different = spark.createDataFrame([(i, f"{text} x{i}", "en") for i in range(300)], schema)
    assert rules.quality_verdicts(different, labels).first().cutoffs is not None
    assert rules.quality_verdicts(different.where("false"), labels).collect() == []
